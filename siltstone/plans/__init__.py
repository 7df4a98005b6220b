"""Driver-side planning of one pattern."""
