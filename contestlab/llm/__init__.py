"""Training-data operators: scoring, deduplication, search, mixing, packing and sharding of text corpora."""
