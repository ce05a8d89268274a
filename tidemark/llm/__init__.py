"""Training-data operators: sharding, deduplication, scoring, mixing, search."""
