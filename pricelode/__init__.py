"""Listing-price analytics on Spark: tables and streams in, DataFrames out."""

__version__ = "0.1.0"
