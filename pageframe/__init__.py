"""Document-layout analytics on Spark: positioned page primitives in, page results out."""

__version__ = "0.1.0"
