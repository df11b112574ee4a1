"""Scenario runs and the registered query catalogue."""
