"""Corpus cleaning and collocation analytics expressed as Spark DataFrame plans."""
