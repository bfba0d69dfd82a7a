"""The same computations as Structured Streaming."""
