"""Training-data operators: scoring, packing, near-copies, decontamination, secrets, sharding, search."""
