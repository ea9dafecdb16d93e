"""Rhythm metrics over network packet metadata, as Spark jobs."""
