"""Numerical kernels on NumPy arrays. No kernel imports Spark; the wrappers in panelforge.operators carry them to DataFrames."""
