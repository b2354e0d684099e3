"""Readers, conforming of raw feeds, sinks and data-quality checks."""
