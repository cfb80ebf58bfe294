"""Readers of package trees: files, hook resolution and read errors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packsieve.functions import recipe
from packsieve.functions.textnorm import MAX_FILE_BYTES
from packsieve.session import ship


def _declared(batches):
    names = ["dir", "content", "pkgname", "install", "declared"]
    for b in batches:
        told = []
        for content in b.column(1).to_pylist():
            record = recipe.parse_recipe(content or "")
            told.append(((record["pkgname"] or [None])[0], recipe.install_name(record), bool(record.get("install"))) if record else (None, None, False))
        made = [pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=names)


def spread(files: DataFrame) -> DataFrame:
    """``files`` dealt over all cores where the table has too few parts for that; a large table stays as it is."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(2 * cores) if files.rdd.getNumPartitions() < 4 * cores else files


def read_tree(spark: SparkSession, root: str, names: str | None = None) -> DataFrame:
    """All files below ``root``: dir, name, content, error (too large or not UTF-8). ``names`` is a glob that file names must
    meet; a hook may have any name, so the default takes all. Files over the limit are listed and not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (raw.option("pathGlobFilter", names) if names else raw).load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = raw.where(F.col("length") <= MAX_FILE_BYTES).select("path", text.alias("content"), F.when(text.isNull(), "not UTF-8").alias("error"))
    large = raw.where(F.col("length") > MAX_FILE_BYTES).select("path", F.lit(None).cast("string").alias("content"), F.lit("too large").alias("error"))
    both = read.unionByName(large)
    return both.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content", "error")


def resolve_hooks(tree: DataFrame) -> DataFrame:
    """Files of each package: its recipe, and the hook that the recipe names, or else the one found beside it.

    Of several ``.install`` files the one with the package's name comes first, then the least name.
    """
    ship(tree.sparkSession)
    told = tree.where("name = 'PKGBUILD' and error is null").select("dir", "content")
    told = told.mapInArrow(_declared, "dir string, content string, pkgname string, install string, declared boolean")
    recipes = told.select(F.col("dir").alias("pkg_id"), F.lit("pkgbuild").alias("file_type"), F.concat("dir", F.lit("/PKGBUILD")).alias("file"), "content")
    named = told.drop("content")
    others = tree.where("name != 'PKGBUILD' and error is null")
    joined = others.join(named, "dir")
    exact = joined.where("declared and name = install")
    found = joined.where("not declared and name like '%.install'")
    order = Window.partitionBy("dir").orderBy(F.desc(F.col("name") == F.concat("pkgname", F.lit(".install"))), "name")
    found = found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    hooks = exact.unionByName(found).select(F.col("dir").alias("pkg_id"), F.lit("install_script").alias("file_type"), F.concat_ws("/", "dir", "name").alias("file"), "content")
    return recipes.unionByName(hooks)


def read_errors(tree: DataFrame) -> DataFrame:
    """What couldn't be read: files with an error, and folders that hold a hook but no recipe."""
    bad = tree.where("error is not null").select(F.col("dir").alias("pkg_id"), F.concat_ws("/", "dir", "name").alias("file"), F.col("error").alias("reason"))
    folders = tree.groupBy("dir").agg(F.bool_or(F.col("name") == "PKGBUILD").alias("recipe"), F.bool_or(F.endswith("name", F.lit(".install"))).alias("hook"))
    bare = folders.where("hook and not recipe").select(F.col("dir").alias("pkg_id"), F.col("dir").alias("file"), F.lit("no recipe").alias("reason"))
    return bad.unionByName(bare)
