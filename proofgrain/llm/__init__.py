"""Operators for cleaning and preparing training text (one module each)."""
