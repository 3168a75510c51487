"""Operators for preparing training data: scoring, formatting, search, packing, extraction,
near-duplicate joins, token counts, source mixing and sharding.

Nothing outside this subpackage imports it.
"""
