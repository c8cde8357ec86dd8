"""Assemble machine-learning tables from messy sources with Spark DataFrames."""
