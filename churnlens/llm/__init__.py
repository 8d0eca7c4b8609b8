"""Operators of a training-data pipeline (search, extraction, filters, dedup, tokens, packing, mixing)."""
