"""Session operators: functions from DataFrame to DataFrame."""
