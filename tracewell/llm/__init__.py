"""Training-data operators: sharding, filtering, deduplication, tokenising, scoring.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; the thin ``op*`` queries live in :mod:`tracewell.llm.queries`.
"""
