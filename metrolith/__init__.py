"""Rhythm analytics over large collections of time series, on PySpark."""
