"""Operators for large training-data pipelines.

Nothing outside this package imports it.  Each module holds one operator with its own general
interface; ``registry`` registers the thin queries that apply them to whole tables.
"""
