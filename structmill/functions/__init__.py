"""Column helpers: paths, text, hashes."""
