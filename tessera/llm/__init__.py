"""Operators for building training corpora (quality, dedup, decontamination, tokenising)."""
