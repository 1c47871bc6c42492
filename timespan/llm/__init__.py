"""Training-data operators: quality, privacy, duplicates, archives, packing and scoring."""
