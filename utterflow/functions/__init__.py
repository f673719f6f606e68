"""Column functions: keys, text, signals."""
