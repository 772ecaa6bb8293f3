"""Scalar functions: projections, spectra, time, units, scaling, as stages of SQL expressions."""
