"""Event streams: parsing, run state, counters, alerts, change feed."""
