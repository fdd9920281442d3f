"""Specs, the filter language and the registered queries."""
