"""Operators that prepare text and records for large training corpora."""
