"""Document-intelligence analytics as DataFrame and Spark SQL operators."""
