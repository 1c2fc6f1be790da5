"""Data-change safety operators for Spark DataFrames and streams."""
