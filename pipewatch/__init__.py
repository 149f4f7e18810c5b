"""Leak-detection analytics for water-network telemetry, on PySpark."""
