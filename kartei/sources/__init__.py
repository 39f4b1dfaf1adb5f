"""Schemas, readers, sinks and the study tables derived from the given tables."""
