"""Column functions: numbers, dates, text."""
