"""Relational operators: DataFrame in, DataFrame out, nothing is executed."""
