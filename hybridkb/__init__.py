"""hybridkb: hybrid retrieval and record analytics as Spark DataFrame operators."""
