"""Terrain analysis on gridded elevation as Spark DataFrames."""
