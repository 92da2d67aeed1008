"""Training-data operations: cleaning, deduplication, mixing and packing of text corpora.

Nothing outside this subpackage imports it; its queries are listed in ``queries.py``.
"""
