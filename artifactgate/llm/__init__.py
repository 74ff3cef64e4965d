"""Operators of a training-data pipeline over text, pages, vectors and conversations."""
