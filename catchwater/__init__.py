"""Flood analytics over many areas as Spark jobs."""
