"""Operators on text corpora: deduplication, scoring, filtering, mixing and packing of documents."""
