"""Spark jobs for retrieval, evaluation and governance of text collections."""
