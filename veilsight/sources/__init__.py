"""Readers for pages, feeds and dimensions, and the export sinks."""
