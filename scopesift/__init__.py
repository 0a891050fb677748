"""Opportunity ranking as Spark DataFrame jobs."""
