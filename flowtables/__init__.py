"""Scheduled SQL transformations as Spark jobs: calendars, windows, lineage, runs, loads and event streams."""
