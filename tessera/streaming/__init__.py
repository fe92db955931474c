"""Append-and-resume runs, and event-time aggregates."""
