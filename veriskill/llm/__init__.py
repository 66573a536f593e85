"""Training-data operators: extraction, scoring, scanning, deduplication and encoding of text corpora."""
