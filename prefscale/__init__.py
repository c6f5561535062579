"""Preference and ranking analytics as PySpark jobs."""
