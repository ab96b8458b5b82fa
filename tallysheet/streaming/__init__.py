"""Streaming forms of the ledger and of event counts."""
