"""Retrieval evaluation and triplet preparation as Spark DataFrame jobs."""
