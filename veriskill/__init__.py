"""Forecast verification on Spark."""
