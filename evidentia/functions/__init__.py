"""Column builders and the signal catalogue."""
