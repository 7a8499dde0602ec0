"""Training-data operators: fingerprints, mixing, packing, search, dedup, scans, scoring, archives."""
