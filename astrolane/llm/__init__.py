"""Operators for large training corpora: one module for each, see README."""
