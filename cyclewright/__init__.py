"""Cyclical-timeline analytics as DataFrame-to-DataFrame transforms on Spark."""
