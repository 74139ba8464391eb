"""Spark-native reconciliation of two ledgers."""
