"""weftline: deterministic synthetic data, schema profiling and data quality on Spark DataFrames."""

__version__ = "0.1.0"
