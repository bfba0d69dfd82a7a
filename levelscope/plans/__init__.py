"""Operators put together as named queries over the given tables, and the SQL they equal."""
