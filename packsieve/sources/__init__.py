"""Readers of package files and tables, and test corpora derived from tables."""
