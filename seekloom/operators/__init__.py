"""Retrieval and maintenance operators: DataFrame in, DataFrame out."""
