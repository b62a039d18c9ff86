"""Operators that prepare code and documents as training data. Nothing outside this package imports it."""
