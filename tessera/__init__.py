"""A rule-based analytics engine whose programs run as Spark DataFrames."""

__version__ = "0.1.0"
