"""meldspark: record fusion and training-data processing on PySpark."""
