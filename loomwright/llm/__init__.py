"""Training-data operators: quality, tokens, media, near duplicates, PII, LM scores, search, chat and packing."""
