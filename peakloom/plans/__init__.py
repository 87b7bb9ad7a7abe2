"""Whole analyses, and queries over the driver's tables."""
