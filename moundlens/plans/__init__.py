"""Composed computations: reports, mixes, densities, studies, swing models."""
