"""Streams of arriving files through the same stateless functions."""
