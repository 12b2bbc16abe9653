"""Lead-prioritisation analytics as PySpark DataFrame operators."""
