"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; the repository works when it is removed.
"""
