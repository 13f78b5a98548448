"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries only when it is there.
"""
