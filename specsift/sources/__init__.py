"""Readers, writers and the derived fixture views over the driver's tables."""
