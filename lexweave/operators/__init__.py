"""Operators on tables: cleaning, tokens, n-grams, vectors, suggestions, evaluation sets."""
