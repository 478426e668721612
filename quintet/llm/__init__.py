"""Operators of a training-data pipeline: deduplication, filtering, formatting, archives, mixing.

Nothing outside this subpackage imports it; ``queries`` holds what
``__spark_entry__`` registers.
"""
