"""Operators for language-model training text; nothing else of the library imports them."""
