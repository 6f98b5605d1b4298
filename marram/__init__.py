"""Spark-first hybrid retrieval, evaluation and corpus-preparation engine."""
