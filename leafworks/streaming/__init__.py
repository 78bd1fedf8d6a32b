"""Logs and events, in batch or as streams."""
