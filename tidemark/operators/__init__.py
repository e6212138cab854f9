"""Operators on bars: functions from DataFrames to DataFrames."""
