"""Readers and writers of peak lists, maps, matrices and parameters."""
