"""Joins, top-k, duplicates, sampling and change detection on DataFrames."""
