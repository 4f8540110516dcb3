"""Grounded retrieval analytics over document tables, as Spark DataFrame jobs."""
