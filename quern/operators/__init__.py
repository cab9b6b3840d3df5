"""Operators on data frames of keys and values."""
