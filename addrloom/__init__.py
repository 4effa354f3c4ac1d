"""Address linkage, data quality and reference validation on Spark."""
