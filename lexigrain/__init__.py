"""lexigrain: full-text indexing and search expressed as Spark DataFrames."""

__version__ = "0.1.0"
