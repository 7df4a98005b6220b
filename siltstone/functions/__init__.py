"""Column functions: bytes, lines, posting lists and what makes a file indexable."""
