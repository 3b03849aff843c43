"""Cleaning, resampling and spectral analysis of keyed (x, y) series on Spark.

A *series* is the set of rows that share the key columns; every operator takes
a DataFrame and the list of key columns and returns a DataFrame.
"""

__version__ = "0.1.0"
