"""Bi-temporal claims analytics on Spark."""
