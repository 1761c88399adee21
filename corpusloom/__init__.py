"""Corpus building, hybrid search and evaluation as Spark DataFrame operators."""
