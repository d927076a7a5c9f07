"""Streams: the clause language over unbounded tables.

The engine's operators are stateless filters and inner joins with tables, which run on streams as they are: a
registered table may be a streaming DataFrame. Nothing else of the reference scope is a stream.
"""
