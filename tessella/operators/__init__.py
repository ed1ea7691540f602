"""Relational, statistical and graph operators on DataFrames."""
