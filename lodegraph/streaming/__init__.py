"""Continuous reading of bundles."""
