"""Operators for large training-data pipelines, each behind a plain function on DataFrames."""
