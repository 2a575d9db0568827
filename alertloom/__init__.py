"""Hazard-advisory analytics as PySpark DataFrame jobs."""
