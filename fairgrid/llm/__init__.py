"""Training-data operators: language, tokens, sharding, dedup, packing, archives, toxicity and vector search."""
