"""Pitch-tracking analytics on Spark: reports, studies and swing models over one pitch log."""
