"""Structured Streaming: continuous aggregates, change streams, geofences."""
