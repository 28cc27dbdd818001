"""Training-data operators: deduplication, tokens, neighbours, privacy, mixing, filters."""
