"""Relational analytics over integer tables, and training-data operators, on PySpark."""
