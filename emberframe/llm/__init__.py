"""Training-data operators: filtering, dedup, sharding, mixing, extraction."""
