"""Single-cell table analytics as PySpark DataFrame operators."""
