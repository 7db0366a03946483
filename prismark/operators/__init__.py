"""Operators: functions from DataFrames to DataFrames. Every all-pairs step carries a blocking key."""
