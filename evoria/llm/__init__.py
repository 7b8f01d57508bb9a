"""Operators for large text corpora: sharding, tokenising, filtering, searching, deduplicating, mixing.

Nothing outside this subpackage imports it.
"""
