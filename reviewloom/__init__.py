"""Review-text analytics as lazy Spark DataFrame operators."""
