"""Passive network inventory analytics on Spark."""
