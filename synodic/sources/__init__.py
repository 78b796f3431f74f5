"""Graphs and snapshots: where simulations come from and go to."""
