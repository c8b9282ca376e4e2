"""Whole jobs: bounded reads per run, and transform, load and hooks."""
