"""Spark jobs for ranked retrieval, record lifecycle, knowledge graphs and training-data preparation."""
