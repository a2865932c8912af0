"""tidelog: versioned keyed state and change-log analytics on Spark DataFrames."""

__version__ = "0.1.0"
