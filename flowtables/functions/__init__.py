"""Column expressions: durations, windows, cron, names, text and macros."""
