"""Operators for building training data: packing, de-duplication, decontamination, scoring and output."""
