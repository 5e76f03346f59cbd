"""Gridded wildfire spread as Spark DataFrames."""
