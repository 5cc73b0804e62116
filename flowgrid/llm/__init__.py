"""Operators for large text corpora: identification, deduplication, scoring, packing and storage.

Nothing outside this subpackage imports it.
"""
