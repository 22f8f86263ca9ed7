"""Scalar helpers, encodings, statistics, vectors and row visibility."""
