"""Scalar functions over columns: text, clocks and time ranges."""
