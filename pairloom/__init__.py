"""Leakage-safe labelled datasets, ensembles and benchmark statistics on Spark DataFrames."""

__version__ = "0.1.0"
