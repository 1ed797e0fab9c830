"""Column functions: scalars and predicates over text, built from Spark's own expressions."""
