"""Operators: functions from DataFrames to a DataFrame, keyed by image_id."""
