"""Readers and writers of bundles and documents."""
