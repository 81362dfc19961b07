"""Operators for building training data from source files and documents. Nothing outside imports this."""
