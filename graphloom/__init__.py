"""Knowledge-graph analytics as plain Spark DataFrame operators."""
