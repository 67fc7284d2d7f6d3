"""Whole studies as one lineage."""
