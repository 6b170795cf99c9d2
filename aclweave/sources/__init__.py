"""Tuples, change log, stores, models and assertions as tables."""
