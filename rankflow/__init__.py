"""rankflow: ranking, retrieval and history analytics on Spark DataFrames."""

__version__ = "0.1.0"
