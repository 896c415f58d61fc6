"""Training-data operators: deduplication, filtering, tokenising and mixing of text corpora."""
