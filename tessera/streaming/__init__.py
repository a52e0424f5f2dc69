"""Operators on streams: winners by key, and windows over event time."""
