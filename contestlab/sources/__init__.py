"""Readers and the views that the queries stand on."""
