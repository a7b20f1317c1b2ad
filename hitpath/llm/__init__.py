"""Operators of a training-data pipeline, one module each, over DataFrames of documents, pages and vectors."""
