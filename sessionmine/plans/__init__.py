"""Jobs: functions from DataFrames to DataFrames that users call."""
