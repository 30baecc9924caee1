"""Corpus preparation and hybrid retrieval as Spark DataFrame jobs."""
