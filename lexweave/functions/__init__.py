"""Column functions: regular expressions, text cleaning, association measures."""
