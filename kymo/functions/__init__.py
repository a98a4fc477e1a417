"""Column builders: no UDFs, every result is a built-in Spark expression."""
