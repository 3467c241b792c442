"""weldrow: record linkage and data preparation declared as Spark DataFrames."""

__version__ = "0.1.0"
