"""Symbol registry, reference checking and output condensing on PySpark."""
