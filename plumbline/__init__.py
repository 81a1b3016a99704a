"""Drift, reconciliation and audit analytics expressed as Spark DataFrame jobs."""
