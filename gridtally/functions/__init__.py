"""Column functions: they take Columns and return Columns."""
