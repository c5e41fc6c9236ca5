"""Scalar kernels: stream filters, text encodings, dates and numerals."""
