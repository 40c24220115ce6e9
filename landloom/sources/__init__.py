"""Readers and writers for layers, control points and summaries."""
