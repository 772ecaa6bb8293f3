"""Operators on frames: coordinates, headers, differences, statistics, checksums, fits."""
