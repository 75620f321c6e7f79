"""Column functions: text, places and time."""
