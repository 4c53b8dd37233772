"""The queries. Each takes DataFrames and returns one; the caller collects or writes it."""
