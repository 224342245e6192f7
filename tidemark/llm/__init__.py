"""Training-data operators: similarity joins, scoring, filtering, sharding, encoding.

Nothing outside this package imports it; its queries are collected in
``tidemark.llm.queries``.
"""
