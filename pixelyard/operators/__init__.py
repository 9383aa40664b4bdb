"""Operators: DataFrame in, DataFrame out; no operator collects its input."""
