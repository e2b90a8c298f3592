"""Training-data operators: sharding, quality, extraction, dedup, output, packing, secrets, mixing."""
