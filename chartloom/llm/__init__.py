"""Training-data operators: deduplication, filtering, formatting and mixing of text corpora.

Nothing outside this package imports it; `queries.py` registers its queries.
"""
