"""Operators over tables of pages, lines, regions and entries."""
