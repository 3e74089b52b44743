"""Tessera: a Spark-first engine for document, code-index, claim and queue tables."""
