"""Operators on DataFrames: joins, sorting, hashing, indexes, statistics, records."""
