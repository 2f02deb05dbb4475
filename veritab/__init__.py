"""Profiling, cleaning, reconciliation and anomaly scoring of tables on Spark."""
