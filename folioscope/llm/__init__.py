"""Training-data operators: deduplication, filtering, packing and tokenising of text at corpus scale."""
