"""Scan analytics and corpus preparation as Spark jobs."""
