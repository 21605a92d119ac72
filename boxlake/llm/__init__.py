"""Operators for building training corpora: cleaning, de-duplication, decontamination, tokens."""
