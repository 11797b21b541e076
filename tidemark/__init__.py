"""Regime analytics for time-series tables, written as Spark DataFrame jobs."""
