"""Streams of new papers."""
