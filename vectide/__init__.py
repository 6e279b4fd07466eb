"""vectide: geometric retrieval over embedding point clouds on Spark DataFrames."""

__version__ = "0.1.0"
