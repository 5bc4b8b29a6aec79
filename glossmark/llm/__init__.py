"""Training-data operators: extraction, filtering, dedup, decontamination, mixing, encoding and sharding."""
