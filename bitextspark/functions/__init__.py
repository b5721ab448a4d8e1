"""Column functions: everything here is built from Spark SQL expressions."""
