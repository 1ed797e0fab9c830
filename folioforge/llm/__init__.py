"""Operators that prepare training text: formatting, tokenising, filtering, deduplication, packing and search.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; `queries` holds the registered queries and their SQL.
"""
