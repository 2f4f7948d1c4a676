"""Harmonising measurement data, auditing splits and scoring models, on Spark DataFrames."""

__version__ = "0.1.0"
