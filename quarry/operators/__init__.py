"""Quarry operators."""
