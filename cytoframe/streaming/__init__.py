"""Incremental and windowed summaries over streams."""
