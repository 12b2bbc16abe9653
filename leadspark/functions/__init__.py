"""Column expressions of the lead domain; everything here runs inside Spark's generated code."""
