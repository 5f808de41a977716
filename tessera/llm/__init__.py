"""Training-data operators: quality, tokenisation, deduplication, privacy, packing."""
