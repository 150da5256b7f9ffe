"""Palimpsest: edit-history, transcript and corpus analytics on Spark DataFrames."""
