"""Panel and time-series analytics on Spark: relational operators, state-space kernels and their grouped-map wrappers."""
