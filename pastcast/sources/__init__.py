"""Sources and sinks: parquet tables, file listings, calendars, run logs."""
