"""Structured Streaming forms of the ledger and event operators."""
