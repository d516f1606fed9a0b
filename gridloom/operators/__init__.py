"""Operators over sparse objects."""
