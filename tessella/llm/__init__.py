"""Training-data operators: dedup, packing, archives, classifiers, search, tokens."""
