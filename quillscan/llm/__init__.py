"""Training-data operators: PII, search, WARC, language ID, packing, chat, URLs, near-dedup, tokens."""
