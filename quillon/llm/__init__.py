"""Training-data operators: near-duplicate removal, extraction, scoring, packing.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; the thin ``opN_*`` queries live in :mod:`quillon.llm.queries`.
"""
