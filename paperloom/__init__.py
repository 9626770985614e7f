"""Document mapping on Spark."""
