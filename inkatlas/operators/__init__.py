"""Relational and vector operators: DataFrame in, DataFrame out."""
