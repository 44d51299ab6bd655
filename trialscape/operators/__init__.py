"""Operators: functions from DataFrame to DataFrame. None of them collects."""
