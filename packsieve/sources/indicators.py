"""Indicator files: TOML tables of campaigns and values, laid over the built-in ones in order."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from packsieve.operators import ioc

#: The tables of a file, and the kind of indicator that each holds.
TABLES = {"npm_packages": "npm", "aur_packages": "package", "files": "file", "domains": "domain", "sha256": "sha256"}


def read_toml(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(indicators, campaigns) of one file."""
    told = tomllib.loads(text)
    rows = [(kind, value.lower() if kind == "sha256" else value, campaign) for table, kind in TABLES.items() for value, campaign in told.get(table, {}).items()]
    campaigns = [(c["id"], c["name"]) for c in told.get("campaigns", [])]
    return spark.createDataFrame(rows, ioc.INDICATOR_TYPE), spark.createDataFrame(campaigns, ioc.CAMPAIGN_TYPE)


def load(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Built-in tables with every readable file of ``paths`` over them, in order, and the files that can't be parsed.

    Of one value the last file's row stays; of one campaign the first. Missing files are passed by.
    """
    tables, bad = [(ioc.default_indicators(spark), ioc.default_campaigns(spark))], {}
    for path in paths:
        if not Path(path).is_file():
            continue
        try:
            tables.append(read_toml(spark, Path(path).read_text()))
        except (ValueError, KeyError, AttributeError) as e:
            bad[path] = f"{type(e).__name__}: {e}"
    return ioc.merge(*[i for i, _ in tables]), ioc.merge_campaigns(*[c for _, c in tables]), bad
