"""Readers, snapshot storage and CSV exports."""
