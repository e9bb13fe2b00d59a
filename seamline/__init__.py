"""Corpus mining, similarity sampling and evaluation analytics as Spark DataFrame plans."""
