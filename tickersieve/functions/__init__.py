"""Column expressions; nothing here touches a DataFrame or runs Python per row."""
