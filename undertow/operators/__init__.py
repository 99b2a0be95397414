"""Operators that need a whole series at once: numerical kernels over Arrow batches."""
