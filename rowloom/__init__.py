"""Streams of rows on Spark: sampling, slicing and kernels over ordered sequences."""
