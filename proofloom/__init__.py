"""Spark-first evidence traceability, retrieval and assessment."""
