"""Operators for training-data pipelines on documents, pages and vectors. Nothing else in the package imports them."""
