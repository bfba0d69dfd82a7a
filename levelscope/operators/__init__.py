"""Operators: DataFrame in, DataFrame out, partitioned by symbol and session."""
