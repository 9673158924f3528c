"""Renderers and writers."""
