"""Queries over the state of a log."""
