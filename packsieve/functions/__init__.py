"""Scalar functions: column expressions and per-text state machines."""
