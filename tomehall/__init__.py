"""A corpus search engine whose plans are Spark DataFrames."""

__version__ = "0.1.0"
