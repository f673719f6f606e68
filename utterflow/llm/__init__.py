"""Operators for large text corpora: deduplication, quality, language, tokens, archives, mixing.

Nothing outside this subpackage imports it.
"""
