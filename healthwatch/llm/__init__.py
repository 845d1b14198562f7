"""Training-data operators (quality, dedup, mixing, tokens, secrets, PII, WARC,
language-model scoring).  Nothing else in the library imports this package."""
