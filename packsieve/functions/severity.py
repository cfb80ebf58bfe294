"""Severities and categories. A lower rank is worse; labels are never compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["critical", "high", "medium", "low", "info"]
RANK = {s: n for n, s in enumerate(SEVERITIES)}
CATEGORIES = [
    "malicious_code", "command_injection", "credential_theft", "data_exfiltration", "privilege_escalation", "persistence", "obfuscation",
    "cryptomining", "network_security", "suspicious_metadata", "dependencies", "cryptography", "configuration",
]


def at_least(rank: Column, threshold: str) -> Column:
    """Whether a severity rank is the threshold's or worse."""
    return rank <= F.lit(RANK[threshold])


def rank_of(label: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), label).cast("int") - 1


def label_of(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), rank)
