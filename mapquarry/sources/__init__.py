"""Readers of harvested catalogs and keyed writers."""
