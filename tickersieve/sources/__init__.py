"""Reading and writing the files the screen works on."""
