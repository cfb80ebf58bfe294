"""Stateful operators over unbounded input."""
