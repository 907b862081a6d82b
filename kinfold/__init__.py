"""Kinfold: does a set of named groups hold together? DataFrame and SQL operators on Spark."""
