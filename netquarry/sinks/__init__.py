"""Renderers of the gold tables, which are small: one row a device, finding or change."""
