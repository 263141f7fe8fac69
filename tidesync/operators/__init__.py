"""Operators: DataFrame in, DataFrame out; writers live in ``tidesync.plans``."""
