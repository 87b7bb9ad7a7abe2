"""Operators over DataFrames of peaks, abundance cells and maps."""
