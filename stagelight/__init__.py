"""Imaging-run analytics on Spark DataFrames."""
