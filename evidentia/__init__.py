"""Evidence corpora on Spark: build, check, search and audit with DataFrames."""

__version__ = "0.1.0"
