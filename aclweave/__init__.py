"""Relationship-based authorization analytics on Spark: model compiler, set-at-a-time checks and listings."""
