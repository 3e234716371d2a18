"""Operators over text corpora: deduplication, filters, classifiers, decontamination and packing."""
