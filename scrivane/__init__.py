"""Scrivane: document and media analytics as Spark DataFrame operators."""
