"""Training-data operators: ten jobs over documents, pages, conversations and embeddings.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
