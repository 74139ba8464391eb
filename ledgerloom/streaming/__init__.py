"""Micro-batch reconciliation."""
