"""Cluster energy, job and thermal analytics as Spark jobs."""
