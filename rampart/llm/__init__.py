"""Operators of a training-data pipeline: pages, URLs, near copies, tokens, licences, quality, secrets, leaks, archives."""
