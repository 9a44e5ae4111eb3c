"""Relational, signal and statistical operators: DataFrame in, DataFrame out."""
