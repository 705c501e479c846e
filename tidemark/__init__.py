"""Ordered-event and timeline analytics on Spark."""
