"""Named reports: functions from tables to lazy result DataFrames."""
