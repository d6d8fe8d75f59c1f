"""Operators for building training corpora: fingerprints, classifiers, deduplication, decontamination, mixing."""
