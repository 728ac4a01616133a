"""Point-in-time analytics for irregular series, and training-data operators, on PySpark."""
