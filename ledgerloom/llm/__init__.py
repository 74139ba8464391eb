"""Operators that prepare documents for language-model training. Nothing else in the library imports this package."""
