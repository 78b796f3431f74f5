"""Neighbourhoods, transitions, rasters and reductions over the tables of a simulation."""
