"""Operators for preparing text corpora: deduplication, extraction, filtering, mixing, packing.

Nothing else in the library imports this subpackage. ``queries.REGISTRY`` has one ``opN_<name>``
query per operator and the corpus pipeline; ``queries.ORACLE`` has their SQL twins.
"""
