"""Revenue-operations analytics as Spark DataFrame operators."""
