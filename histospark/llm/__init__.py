"""Training-data operators: scoring, tokenizing, deduplication, archives and mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
