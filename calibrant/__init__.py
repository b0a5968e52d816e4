"""Calibrant: evidence, calibration and population analytics as Spark DataFrame jobs."""
