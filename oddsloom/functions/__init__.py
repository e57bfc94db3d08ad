"""Column functions: numbers, text, teams and dates."""
