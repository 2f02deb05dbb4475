"""Operators for preparing language-model training text, each usable on its own."""
