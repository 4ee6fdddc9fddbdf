"""Transcript, timeline and evidence operators for Spark DataFrames."""
