"""Operators for language-model training corpora; nothing outside imports this package."""
