"""Whole reconciliations, reports and the registered queries."""
