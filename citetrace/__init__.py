"""Trace how flagged records spread through a citation graph, on Spark."""
