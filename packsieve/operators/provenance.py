"""Behaviour gained between versions of a package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markers of risky behaviour and the lower-case texts that show them.
MARKERS = {
    "npm": ["npm install", "npm i ", "npm ci"],
    "pnpm": ["pnpm install", "pnpm add"],
    "yarn": ["yarn add", "yarn install"],
    "bun": ["bun install", "bun add", "bunx"],
    "pipe-shell": ["| sh", "|sh", "| bash", "|bash"],
    "eval": ["eval "],
    "base64-decode": ["base64 -d", "base64 --decode"],
    "reverse-shell": ["/dev/tcp/"],
    "ebpf": [".bpf.c", ".bpf.o"],
    "curl-net": ["curl ", "wget "],
}
#: What a report calls them.
LABELS = {
    "npm": "npm package install", "pnpm": "pnpm install", "yarn": "yarn install", "bun": "bun install", "pipe-shell": "pipe to shell", "eval": "eval",
    "base64-decode": "base64 decode", "reverse-shell": "raw TCP socket", "ebpf": "eBPF object", "curl-net": "curl/wget fetch",
}


def _found(low: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(F.greatest(*[F.contains(low, F.lit(n)).cast("int") for n in needles], F.lit(0)) > 0, F.lit(k)) for k, needles in MARKERS.items()])))


def markers(text: Column) -> Column:
    return _found(F.lower(text))


def gained(snapshots: DataFrame, key: str = "package", version: str = "version", digest: str = "digest", marks: str = "markers") -> DataFrame:
    """Rows of ``snapshots`` whose content changed, with the markers that the last changed version lacked.

    The first version of a package is its baseline. One shuffle, on the package.
    """
    order = Window.partitionBy(key).orderBy(version)
    changed = snapshots.withColumn("_was", F.lag(digest).over(order)).where(F.col("_was").isNull() | (F.col("_was") != F.col(digest)))
    before = changed.withColumn("_before", F.lag(marks).over(order))
    return before.where("_before is not null").select(key, version, F.array_sort(F.array_except(marks, "_before")).alias("gained")).where("size(gained) > 0")


def known_state(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stored baseline, from rows (package, record: JSON), and the rows that can't be read, to be put aside.

    The state is (package, digest, markers, last_seen), one row a package: of several the one seen last. A row that is no
    JSON or lacks a part is quarantined, so that its package starts anew and the loss is seen.
    """
    told = raw.withColumn("_r", F.from_json("record", "digest string, markers array<string>, last_seen string"))
    good = F.coalesce(F.col("_r.digest").isNotNull() & F.col("_r.markers").isNotNull(), F.lit(False))
    newest = F.max_by("_r", F.struct("_r.last_seen", "_r.digest"))
    return told.where(good).groupBy("package").agg(newest.alias("_r")).select("package", "_r.*"), told.where(~good).select("package", "record")


def stored(state: DataFrame) -> DataFrame:
    """The rows that ``known_state`` reads. A state with two rows of one package is refused."""
    per = state.groupBy("package").agg(F.count("*").alias("n"), F.first(F.struct("digest", "markers", "last_seen")).alias("r"))
    record = F.when(F.col("n") == 1, F.to_json("r")).otherwise(F.raise_error(F.concat(F.lit("two states of package "), F.col("package"))))
    return per.select("package", record.alias("record"))


def snapshots(files: DataFrame, now: Column) -> DataFrame:
    """(package, file, digest, markers, last_seen), one row a package, of contents (pkg_id, file_type, file, content).

    A package's texts are one: its recipe, then its other files by name. Markers don't cross lines, so those of a package
    are those of its files, and each file is searched where it is; ``digest`` is the text's, or of several files that of
    their digests in order. ``file`` is the first file. Files without content are none; a package without any has no row.
    """
    later = F.col("file_type") != "pkgbuild" if "file_type" in files.columns else F.lit(False)
    told = files.where("content is not null").select(F.col("pkg_id").alias("package"), later.alias("later"), "file", F.sha2("content", 256).alias("digest"), F.lower("content").alias("low"))
    told = told.select("package", F.struct("later", "file", "digest").alias("f"), _found(F.col("low")).alias("m"))
    per = told.groupBy("package").agg(F.array_sort(F.collect_list("f")).alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("m")))).alias("markers"))
    digest = F.when(F.size("f") == 1, F.get("f.digest", F.lit(0))).otherwise(F.sha2(F.array_join("f.digest", "\n"), 256))
    return per.select("package", F.get("f.file", F.lit(0)).alias("file"), digest.alias("digest"), "markers", now.alias("last_seen"))


def findings(current: DataFrame, state: DataFrame) -> DataFrame:
    """PROV-001 for each package whose content shows markers that its stored snapshot lacks; a first sight is no finding."""
    was = state.select("package", F.col("markers").alias("_was"))
    rows = current.join(was, "package").withColumn("_new", F.array_sort(F.array_except("markers", "_was"))).where("size(_new) > 0")
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return rows.select(
        F.col("package").alias("pkg_id"), F.lit("PROV-001").alias("id"), F.lit("high").alias("severity"), "file", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"),
        F.lit(None).cast("string").alias("snippet"), F.array_join(F.transform("_new", lambda m: names[m]), ", ").alias("detail"), F.lit(0).alias("ord"),
    )


def next_state(current: DataFrame, state: DataFrame) -> DataFrame:
    """The baseline after a scan: changed and new packages with what they are now, others as they were."""
    now = current.select("package", *[F.col(c).alias(f"_{c}") for c in ("digest", "markers", "last_seen")])
    both = state.join(now, "package", "full_outer")
    same = F.col("_digest").isNull() | F.col("digest").eqNullSafe(F.col("_digest"))
    return both.select("package", *[F.when(same, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("digest", "markers", "last_seen")])
