"""Operators for preparing language-model training data (kept apart: nothing else in the library imports them)."""
