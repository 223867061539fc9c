"""Training-data operators: deduplication, scoring, decontamination, packing, archives."""
