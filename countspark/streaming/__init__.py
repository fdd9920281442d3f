"""Counts that are kept up to date by streams."""
