"""Astrolane: container files, world coordinates and units as Spark frames."""
