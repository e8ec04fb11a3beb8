"""Operators for building training corpora at scale.

Nothing outside this folder imports it; it can be removed as a whole.
"""
