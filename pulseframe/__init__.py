"""Physiological telemetry analytics as composable PySpark DataFrame operators."""
