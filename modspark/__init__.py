"""modspark: single-molecule modification analytics on PySpark."""
