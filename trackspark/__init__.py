"""Detection-event analytics as Spark DataFrame operators."""
