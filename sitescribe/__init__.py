"""Site-audit analytics and training-data operators, written for PySpark."""
