"""Training-data operators: deduplication, extraction, filtering, packing and token files."""
