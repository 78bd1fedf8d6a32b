"""Readers of files as tables, writers of results, and optional adapters for PDF and model services."""
