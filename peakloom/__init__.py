"""A PySpark engine for untargeted omics peak tables."""
