"""Training-data operators: tokenizing, sharding, deduplication, filters and scans.

Nothing outside this subpackage imports it.  Operators take DataFrames and
column names and return DataFrames; :mod:`parlance.llm.queries` applies each
with production parameters to its table.
"""
