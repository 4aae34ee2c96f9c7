"""ZIP archives as DataFrames: plan, create, list, test and extract them with Spark."""

__version__ = "0.1.0"
