"""Operators for preparing training text: ten self-contained building blocks."""
