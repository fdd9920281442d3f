"""Counts, suppression, models, metrics and analyses over DataFrames."""
