"""Operators of a training-data pipeline: filtering, language, duplicates, tokens, archives."""
