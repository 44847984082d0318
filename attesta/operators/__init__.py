"""Operators: functions from DataFrames to DataFrames, over all facts at once."""
