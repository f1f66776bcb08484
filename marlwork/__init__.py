"""Corpus retrieval, text governance and training-data preparation on PySpark."""
