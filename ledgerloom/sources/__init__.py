"""Readers and writers of ledgers, line tables and results."""
