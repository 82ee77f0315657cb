"""Code-graph and quality analytics as Spark DataFrame operators."""
