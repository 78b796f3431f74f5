"""Column helpers: ids, reductions, fixed-width text."""
