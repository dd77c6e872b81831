"""Operators of a training-data pipeline: tokenise, pack, filter, deduplicate, redact, archive, search."""
