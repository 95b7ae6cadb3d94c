"""Operators for large training-data pipelines: deduplication, quality, tokenising, archives and packing.

Nothing outside this subpackage imports it. The registered queries and their SQL are in `queries`.
"""
