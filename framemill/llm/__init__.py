"""Training-data operators: dedup, joins, scans, sharding, tokens, mixing, toxicity, decontamination and search."""
