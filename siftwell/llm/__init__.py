"""Operators for building training corpora.

Nothing outside this subpackage imports it; the library works without it.
"""
