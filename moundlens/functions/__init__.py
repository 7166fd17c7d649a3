"""Column-level helpers: missing-value rules, rounding, text, hashing."""
