"""Reports: JSON, SARIF, text, severity summaries and CycloneDX documents, one row per package or closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ["sev_rank", "analyzer_ord", "ord", "line", "pat_idx", "id"]


def _ordered(*fields: str):
    """All findings of a package as an array of structs, in report order."""
    return F.array_sort(F.collect_list(F.struct(*ORDER, *[f for f in fields if f not in ORDER])))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


VERSION = "1"


def scan_json(findings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(pkg_id, report) with the findings of each package; with ``files`` (pkg_id, file) also which files were scanned, and
    packages without findings."""
    rows = findings.groupBy("pkg_id").agg(_ordered("severity", "category", "title", "file", "column", "snippet", "detail", "recommendation", "cwe_id").alias("f"))
    if files is not None:
        rows = files.groupBy("pkg_id").agg(F.array_sort(F.collect_set("file")).alias("scanned")).join(rows, "pkg_id", "left")
    found = F.coalesce("f", F.array())
    shown = F.transform(found, lambda f: F.struct(f["id"].alias("id"), f["severity"].alias("severity"), f["category"].alias("category"), f["title"].alias("title"), F.struct(f["file"].alias("file"), f["line"].alias("line"), f["column"].alias("column"), f["snippet"].alias("snippet")).alias("location"), f["recommendation"].alias("recommendation"), f["cwe_id"].alias("cwe_id"), F.struct(f["detail"].alias("detail")).alias("metadata")))
    scanned = [F.col("scanned").alias("scanned_files")] if files is not None else []
    return rows.select("pkg_id", F.to_json(F.struct(F.lit(VERSION).alias("version"), F.col("pkg_id").alias("package"), *scanned, shown.alias("findings"))).alias("report"))


def sarif(findings: DataFrame, distinct_rules: bool = False) -> DataFrame:
    """(pkg_id, report) in SARIF 2.1.0; rules are listed once a finding, or once each."""
    rows = findings.groupBy("pkg_id").agg(_ordered("severity", "title", "file").alias("f"))
    level = lambda s: F.when(s.isin("critical", "high"), "error").when(s == "medium", "warning").otherwise("note")
    rules = F.transform("f", lambda f: F.struct(f["id"].alias("id"), f["title"].alias("name")))
    results = F.transform("f", lambda f: F.struct(f["id"].alias("ruleId"), level(f["severity"]).alias("level"), F.struct(f["title"].alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(f["file"].alias("uri")).alias("artifactLocation"), F.struct(F.coalesce(f["line"], F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations")))
    driver = F.struct(F.lit("packsieve").alias("name"), (F.array_distinct(rules) if distinct_rules else rules).alias("rules"))
    doc = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"), results.alias("results"))).alias("runs"))
    return rows.select("pkg_id", F.to_json(doc).alias("report"))


def text(findings: DataFrame) -> DataFrame:
    """(pkg_id, report): a line a finding, with its code below where there is some, what to do and the weakness it is."""
    rows = findings.groupBy("pkg_id").agg(_ordered("severity", "title", "file", "snippet", "recommendation", "cwe_id").alias("f"))
    none = F.lit("")
    more = lambda before, x: F.coalesce(F.concat(F.lit(before), x), none)
    line = F.transform("f", lambda f: F.concat(
        F.lit("["), F.upper(f["severity"]), F.lit("] "), f["id"], F.lit(" "), f["title"], F.coalesce(F.concat(F.lit(" ("), f["file"], F.coalesce(F.concat(F.lit(":"), f["line"].cast("string")), none), F.lit(")")), none),
        more("\n    code: ", f["snippet"]), more("\n    do: ", f["recommendation"]), more("\n    see: ", f["cwe_id"]),
    ))
    return rows.select("pkg_id", F.array_join(line, "\n").alias("report"))


def component_scan(findings: DataFrame) -> DataFrame:
    """Per package: critical and high counts, whether it runs remote code, and the URLs it does that from."""
    urls = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("id") == "EXEC-REMOTE", F.struct("line", "detail")))), lambda x: F.split(x["detail"], " "))))
    return findings.groupBy("pkg_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.bool_or(F.col("id") == "EXEC-REMOTE").alias("opaque"), urls.alias("urls"))


def components(nodes: DataFrame, scans: DataFrame) -> DataFrame:
    """(name, component): the CycloneDX component of each node, with what its scan says as properties."""
    both = nodes.join(scans.withColumnRenamed("pkg_id", "name"), "name", "left")
    prop = lambda k, v: F.struct(F.lit(f"packsieve:{k}").alias("name"), v.cast("string").alias("value"))
    properties = F.array(prop("origin", F.col("origin")), prop("depth", F.col("depth")), prop("critical", F.coalesce("critical", F.lit(0))), prop("high", F.coalesce("high", F.lit(0))))
    return both.select("name", F.struct(F.lit("library").alias("type"), F.col("name").alias("bom-ref"), F.col("name").alias("name"), F.concat(F.lit("pkg:alpm/arch/"), "name").alias("purl"), properties.alias("properties")).alias("component"))


def vulnerabilities(nodes: DataFrame, findings: DataFrame) -> DataFrame:
    """(name, vulnerability): one per package of the closure and finding."""
    inside = findings.join(nodes.select(F.col("name").alias("pkg_id")), "pkg_id", "left_semi")
    return inside.select(F.col("pkg_id").alias("name"), F.struct(F.col("id").alias("id"), F.array(F.struct(F.col("severity").alias("severity"))).alias("ratings"), F.col("title").alias("description"), F.col("recommendation").alias("recommendation"), F.array(F.struct(F.col("pkg_id").alias("ref"))).alias("affects")).alias("vulnerability"))


def sbom(nodes: DataFrame, edge_table: DataFrame, scans: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One CycloneDX 1.5 document of a closure of bounded size: components by name, dependencies of nodes that have any, and
    with ``findings`` its vulnerabilities. The serial is a digest of what the document holds."""
    listed = lambda df, c: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("name", c))), lambda x: x[c]).alias("part"))
    own = edge_table.join(nodes.select(F.col("name").alias("parent")), "parent", "left_semi")
    deps = own.groupBy(F.col("parent").alias("name")).agg(F.array_sort(F.collect_set("child")).alias("below")).select("name", F.struct(F.col("name").alias("ref"), F.col("below").alias("dependsOn")).alias("dependency"))
    parts = [("components", listed(components(nodes, scans), "component")), ("dependencies", listed(deps, "dependency"))]
    if findings is not None:
        parts.append(("vulnerabilities", listed(vulnerabilities(nodes, findings), "vulnerability")))
    both = None
    for name, part in parts:
        part = part.withColumnRenamed("part", name)
        both = part if both is None else both.crossJoin(part)  # one row each
    names = [F.col(n) for n, _ in parts]
    mark = F.sha2(F.to_json(F.struct(*names)), 256)
    serial = F.concat_ws("-", F.concat(F.lit("urn:uuid:"), F.substring(mark, 1, 8)), *[F.substring(mark, a, n) for a, n in ((9, 4), (13, 4), (17, 4), (21, 12))])
    return both.select(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), serial.alias("serialNumber"), *names)).alias("bom"))
