"""How steps become tables."""
