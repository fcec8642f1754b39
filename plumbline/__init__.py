"""Plumbline: reliability analytics for agent reasoning traces, as Spark jobs."""
