"""Compositions of several operators into one scored result."""
