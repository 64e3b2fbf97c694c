"""Training-data operators: mixing, near-duplicates, scoring, packing, quality and language."""
