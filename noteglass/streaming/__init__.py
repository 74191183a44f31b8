"""Streams of run records."""
