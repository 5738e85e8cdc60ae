"""Dataflow operators, each from DataFrames to a DataFrame."""
