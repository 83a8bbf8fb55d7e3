"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing else in the package imports this one; ``__spark_entry__`` registers its queries when it
is present.
"""
