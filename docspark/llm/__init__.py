"""Training-data operators: dedup, quality, tokens, packing, language models."""
