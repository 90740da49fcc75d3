"""Training-data operators: sharding, filtering, deduplication, scoring and packing."""
