"""Steps driven by a stream of tables."""
