"""Document retrieval and training-data jobs on Spark."""
