"""Column expressions: everything here is a Catalyst expression, no Python UDF."""
