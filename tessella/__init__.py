"""Participation analytics on Spark."""
