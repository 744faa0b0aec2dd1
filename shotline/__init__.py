"""Retrieval analytics over tables of media frames, documents and events, as Spark DataFrame operators."""
