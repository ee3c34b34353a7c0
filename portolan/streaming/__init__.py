"""Incremental models as streams."""
