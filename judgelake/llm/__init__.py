"""Operators on text corpora for language-model training data; nothing outside imports this package."""
