"""Operators of a training-data pipeline: tokens, mixing, quality, secrets, duplicates, licenses, search."""
