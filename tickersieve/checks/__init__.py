"""SQL to check results with, and the comparison."""
