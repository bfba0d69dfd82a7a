"""levelscope: market-state analytics over trade-and-quote tapes, as Spark jobs."""
