"""Operators of a training-data pipeline: dedup, quality, PII, secrets, tokenizers, HTML, WARC."""
