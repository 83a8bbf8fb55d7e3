"""DataFrame operators (each takes and returns a Spark DataFrame)."""
