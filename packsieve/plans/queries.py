"""Registered queries over the test tables and, where SQL can say the same, their DuckDB text.

Each is a function of (session, folder of tables) that reads whole tables. The tables hold no recipes, so line and rule
queries run on ``scripts``, which is made from ``documents`` by the same formula in both engines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packsieve.functions import neturl
from packsieve.operators import catalog, gates, graph, ioc, provenance, report, scan, verdicts
from packsieve.sources import packages
from packsieve.sources.scripts import scripts, scripts_sql
from packsieve.store import Workspace, settle, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prior(spark: SparkSession, d: str) -> DataFrame:
    """The former versions of all scripts."""
    return scripts(_t(spark, d, "documents"), 5)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# lines


@query("SELECT doc_id, count(*)::BIGINT AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def lines_explode(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


def _physical(spark, d):
    return scripts(_t(spark, d, "documents")).select("pkg_id", F.posexplode(F.split("content", "\n")).alias("n", "line"))


_PHYSICAL = f"WITH s AS ({scripts_sql()}), p AS (SELECT pkg_id, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS n FROM s)"


@query(f"""{_PHYSICAL}, f AS (SELECT *, (length(line) - length(rtrim(line, '\\'))) % 2 = 1 AS more FROM p),
g AS (SELECT *, coalesce(sum(CASE WHEN NOT more THEN 1 ELSE 0 END) OVER (PARTITION BY pkg_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM f)
SELECT pkg_id, (min(n) + 1)::BIGINT AS line_no, count(*)::BIGINT AS n_physical, string_agg(CASE WHEN more THEN left(line, length(line) - 1) ELSE line END, '' ORDER BY n) AS text
FROM g GROUP BY pkg_id, grp HAVING count(*) > 1""")
def logical_lines(spark, d):
    """Lines spliced at odd trailing backslashes, as a running count within each script."""
    more = F.length("line") - F.length(F.rtrim("line", F.lit("\\")))
    x = _physical(spark, d).withColumn("more", more % 2 == 1)
    before = Window.partitionBy("pkg_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("grp", F.coalesce(F.sum((~F.col("more")).cast("int")).over(before), F.lit(0)))
    part = F.when(F.col("more"), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    x = x.groupBy("pkg_id", "grp").agg((F.min("n") + 1).cast("long").alias("line_no"), F.count("*").alias("n_physical"), F.array_sort(F.collect_list(F.struct("n", part.alias("t")))).alias("parts"))
    return x.where("n_physical > 1").select("pkg_id", "line_no", "n_physical", F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("text"))


@query(f"{_PHYSICAL} SELECT pkg_id, count(*) FILTER (ltrim(line) LIKE '#%')::BIGINT AS n_comments, count(*) FILTER (trim(line) != '')::BIGINT AS n_nonblank FROM p GROUP BY pkg_id")
def comment_filter(spark, d):
    x = _physical(spark, d)
    return x.groupBy("pkg_id").agg(F.count_if(F.ltrim("line").startswith("#")).alias("n_comments"), F.count_if(F.trim("line") != "").alias("n_nonblank"))


# rules

#: Rules whose patterns mean the same in both regex dialects: (id, rank, severity, category, pattern).
SHARED_RULES = [
    ("DLE-001", 0, "critical", "command_injection", r"curl .*\| *bash"),
    ("DLE-002", 0, "critical", "command_injection", r"wget .*\| *sh"),
    ("CRED-001", 0, "critical", "credential_theft", r"~/\.ssh/"),
    ("SHELL-002", 0, "critical", "malicious_code", r"nc -[ec] "),
    ("PERSIST-002", 0, "critical", "persistence", r"\.timer"),
    ("OBF-001", 1, "high", "obfuscation", r"base64 -d"),
    ("OBF-002", 1, "high", "command_injection", r"eval "),
    ("URL-001", 1, "high", "network_security", r"https?://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
]
_RULES_SQL = "rules(id, sev_rank, severity, category, pattern) AS (VALUES " + ", ".join(f"('{i}', {r}, '{s}', '{c}', '{p}')" for i, r, s, c, p in SHARED_RULES) + ")"
_HITS_SQL = f"{_PHYSICAL}, {_RULES_SQL}, hits AS (SELECT p.pkg_id, p.n + 1 AS line_no, p.line, r.* FROM p JOIN rules r ON regexp_matches(p.line, r.pattern) WHERE NOT ltrim(p.line) LIKE '#%')"


_SHARED = [catalog.Rule(i, s, c, "PI", None, i, (p,), case_sensitive=True) for i, _, s, c, p in SHARED_RULES]


def _hits(spark, d):
    """(pkg_id, line_no, id, sev_rank, severity, category, column) of the rules over physical lines, by the engine's matcher."""
    none = F.lit(None).cast("string")
    lines = _physical(spark, d).select(
        "pkg_id", F.lit("pkgbuild").alias("file_type"), F.lit("PKGBUILD").alias("file"), (F.col("n") + 1).alias("line_no"), F.col("line").alias("raw"), none.alias("deobf"), none.alias("resolved"),
        F.ltrim("line").startswith("#").alias("is_comment"), F.lit(False).alias("is_info"),
    )
    told = {i: (r, c) for i, r, _, c, _ in SHARED_RULES}
    rank = F.create_map(*[F.lit(x) for i, (r, _) in told.items() for x in (i, r)])
    category = F.create_map(*[F.lit(x) for i, (_, c) in told.items() for x in (i, c)])
    found = scan.rule_matches(lines, _SHARED)
    return found.select("pkg_id", F.col("line").alias("line_no"), "id", rank[F.col("id")].alias("sev_rank"), "severity", category[F.col("id")].alias("category"), "column")


@query(f"{_HITS_SQL} SELECT pkg_id, id, count(*)::BIGINT AS n_lines FROM hits GROUP BY pkg_id, id")
def rule_match_raw(spark, d):
    return _hits(spark, d).groupBy("pkg_id", "id").agg(F.count("*").alias("n_lines"))


@query(f"{_HITS_SQL} SELECT category, severity, count(*)::BIGINT AS n, count(DISTINCT pkg_id)::BIGINT AS n_packages FROM hits GROUP BY category, severity")
def rule_hits_by_category(spark, d):
    return _hits(spark, d).groupBy("category", "severity").agg(F.count("*").alias("n"), F.countDistinct("pkg_id").alias("n_packages"))


@query(f"{_HITS_SQL}, c AS (SELECT pkg_id, id, line_no::BIGINT AS line_no, (strlen(regexp_extract(line, '^(.*?)(?:' || pattern || ')', 1)) + 1)::BIGINT AS col, row_number() OVER (PARTITION BY pkg_id, id ORDER BY line_no) AS k FROM hits) SELECT pkg_id, id, line_no, col FROM c WHERE k = 1")
def rule_first_hit_column(spark, d):
    """First line of each rule in each script, with the match's byte column."""
    x = _hits(spark, d).groupBy("pkg_id", "id").agg(F.min(F.struct("line_no", "column")).alias("f"))
    return x.select("pkg_id", "id", F.col("f.line_no").cast("long").alias("line_no"), F.col("f.column").cast("long").alias("col"))


@query(f"{_HITS_SQL} SELECT pkg_id, min(sev_rank)::INTEGER AS worst, count(*)::BIGINT AS n_findings, bool_or(sev_rank <= 1) AS tripped FROM hits GROUP BY pkg_id")
def severity_gate(spark, d):
    return gates.severity_gate(_hits(spark, d))


@query(f"{_HITS_SQL} SELECT category, severity, count(*)::BIGINT AS n FROM hits GROUP BY ROLLUP(category, severity)")
def severity_rollup(spark, d):
    return _hits(spark, d).rollup("category", "severity").agg(F.count("*").alias("n"))


@query(f"{_HITS_SQL}, g AS (SELECT pkg_id, min(sev_rank)::INTEGER AS worst, count(*)::BIGINT AS n_findings FROM hits GROUP BY pkg_id) SELECT * FROM g ORDER BY worst, n_findings DESC, pkg_id LIMIT 20")
def worst_first_topk(spark, d):
    g = gates.severity_gate(_hits(spark, d)).drop("tripped")
    return g.orderBy("worst", F.desc("n_findings"), "pkg_id").limit(20)


@query(f"{_HITS_SQL} SELECT pkg_id, count(*) FILTER (severity = 'critical')::BIGINT AS critical, count(*) FILTER (severity = 'high')::BIGINT AS high, bool_or(id IN ('DLE-001', 'DLE-002')) AS opaque FROM hits GROUP BY pkg_id")
def component_scan_rollup(spark, d):
    h = _hits(spark, d)
    return h.groupBy("pkg_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.bool_or(F.col("id").isin("DLE-001", "DLE-002")).alias("opaque"))


# the whole engine over scripts: state machines have no SQL, tests hold them against fixtures


def _scanned(spark, d, f, rules=catalog.RULES, parts=scan.PARTS):
    """``f`` of the scan of all scripts, whose parsed files, with ``parts``, are kept in the shared folder until it is computed."""
    with Workspace(spark, "scan") as work:
        return settle(f(scan.Context(packages.spread(scripts(_t(spark, d, "documents"))), work, rules, parts)))


@query()
def scan_findings(spark, d):
    return _scanned(spark, d, scan.findings)


@query()
def deobf_match(spark, d):
    return _scanned(spark, d, lambda c: scan.rule_matches(c.lines).groupBy("id", "variant").agg(F.count("*").alias("n")), parts=("lines",))


@query()
def informational_mask(spark, d):
    return _scanned(spark, d, lambda c: c.lines.groupBy("is_comment", "is_info").agg(F.count("*").alias("n"), F.count("deobf").alias("n_deobf"), F.count("resolved").alias("n_resolved")), parts=("lines",))


@query()
def sarif_report(spark, d):
    return _scanned(spark, d, lambda c: report.sarif(scan.findings(c)))


@query()
def text_report(spark, d):
    return _scanned(spark, d, lambda c: report.text(scan.findings(c)))


@query()
def json_report(spark, d):
    return _scanned(spark, d, lambda c: report.scan_json(scan.findings(c)))


# text shapes

_IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


@query(f"SELECT doc_id, regexp_extract(text, '{_IP}') AS address FROM documents WHERE regexp_matches(text, '{_IP}')")
def raw_ip_texts(spark, d):
    return _t(spark, d, "documents").where(F.col("text").rlike(_IP)).select("doc_id", F.regexp_extract("text", _IP, 0).alias("address"))


@query("SELECT doc_id, length(regexp_extract(text, '[A-Za-z0-9+/]{40,}={0,2}'))::BIGINT AS blob_len FROM documents WHERE regexp_matches(text, '[A-Za-z0-9+/]{40,}')")
def encoded_blob_len(spark, d):
    x = _t(spark, d, "documents").where(F.col("text").rlike("[A-Za-z0-9+/]{40,}"))
    return x.select("doc_id", F.length(F.regexp_extract("text", "[A-Za-z0-9+/]{40,}={0,2}", 0)).cast("long").alias("blob_len"))


@query("SELECT length(w)::BIGINT AS token_len, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[0-9a-f]{16,}')) AS w FROM documents) GROUP BY 1")
def hex_token_shape(spark, d):
    x = _t(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[0-9a-f]{16,}"), F.lit(0))).alias("w"))
    return x.groupBy(F.length("w").cast("long").alias("token_len")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_fingerprint(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT sha256(text) AS digest, count(*)::BIGINT AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, d):
    x = _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return x.where("copies > 1")


# URLs and hosts

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_UNDER = lambda h, names: "(" + " OR ".join(f"{h} = '{n}' OR ends_with({h}, '.{n}')" for n in names) + ")"
_TRUSTED_SITES = ["example.org", "example.com"]


@query("SELECT page_id, lower(split_part(url, '://', 1)) AS protocol FROM pages")
def protocol_classify(spark, d):
    return _t(spark, d, "pages").select("page_id", neturl.protocol(F.col("url")).alias("protocol"))


@query("SELECT count(*) FILTER (url LIKE 'http://%')::BIGINT AS insecure, count(*)::BIGINT AS total FROM pages")
def insecure_transport(spark, d):
    p = neturl.protocol(F.col("url"))
    return _t(spark, d, "pages").agg(F.count_if(~p.isin(*neturl.SECURE)).alias("insecure"), F.count("*").alias("total"))


@query(f"SELECT page_id, {_HOST} AS host FROM pages")
def host_extract(spark, d):
    return _t(spark, d, "pages").select("page_id", neturl.host(F.col("url")).alias("host"))


@query(f"SELECT page_id, {_UNDER(_HOST, _TRUSTED_SITES)} AS trusted FROM pages")
def trusted_host_suffix(spark, d):
    return _t(spark, d, "pages").select("page_id", neturl.host_in(neturl.host(F.col("url")), _TRUSTED_SITES).alias("trusted"))


@query(f"SELECT {_HOST} AS host, count(*)::BIGINT AS n FROM pages WHERE NOT {_UNDER(_HOST, _TRUSTED_SITES)} GROUP BY 1")
def untrusted_host_anti(spark, d):
    x = _t(spark, d, "pages").select(neturl.host(F.col("url")).alias("host"))
    return x.where(~neturl.host_in(F.col("host"), _TRUSTED_SITES)).groupBy("host").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, {_HOST} AS host FROM pages")
def refang_hosts(spark, d):
    """Hosts read back from URLs whose dots and schemes were disguised."""
    hidden = F.regexp_replace(F.regexp_replace("url", r"\.", "[.]"), "^http", "hxxp")
    return _t(spark, d, "pages").select("page_id", neturl.host(hidden).alias("host"))


_FORGE_OF = "['https://github.com/a/', 'https://gitlab.com/a/', 'https://raw.githubusercontent.com/a/', 'https://files.example.net/']"


@query(f"""WITH u AS (SELECT page_id, {_FORGE_OF}[(page_id % 4 + 1)::INTEGER] AS home, {_FORGE_OF}[(page_id // 4 % 4 + 1)::INTEGER] AS source FROM pages),
k AS (SELECT page_id, CASE WHEN home LIKE '%github%' THEN 'github' WHEN home LIKE '%gitlab%' THEN 'gitlab' END AS a, CASE WHEN source LIKE '%github%' THEN 'github' WHEN source LIKE '%gitlab%' THEN 'gitlab' END AS b FROM u)
SELECT page_id, a AS home_forge, b AS source_forge FROM k WHERE a != b""")
def forge_mismatch(spark, d):
    urls = F.array(*map(F.lit, ["https://github.com/a/", "https://gitlab.com/a/", "https://raw.githubusercontent.com/a/", "https://files.example.net/"]))
    pick = lambda n: neturl.forge(neturl.host(F.get(urls, n.cast("int"))))
    x = _t(spark, d, "pages").select("page_id", pick(F.col("page_id") % 4).alias("home_forge"), pick(F.floor(F.col("page_id") / 4) % 4).alias("source_forge"))
    return x.where("home_forge != source_forge")


# package names

_SPEC = "replace(p_name, ' ', '-') || CASE p_partkey % 4 WHEN 0 THEN '>=1.2' WHEN 1 THEN ': for docs' WHEN 2 THEN '=3' ELSE '' END"


@query(f"SELECT p_partkey, trim(regexp_extract({_SPEC}, '^[^:<>=]*')) AS name FROM part")
def dep_name_strip(spark, d):
    return _t(spark, d, "part").select("p_partkey", neturl.dep_name(F.expr(_SPEC)).alias("name"))


@query("SELECT p_partkey, regexp_matches(n, '^[A-Za-z0-9@_+][A-Za-z0-9@._+-]{0,255}$') AS valid FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '-' || p_partkey::VARCHAR ELSE 'lib' || p_partkey::VARCHAR END AS n FROM part)")
def valid_package_name(spark, d):
    k = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("-"), k)).otherwise(F.concat(F.lit("lib"), k))
    return _t(spark, d, "part").select("p_partkey", neturl.valid_name(name).alias("valid"))


_CLAIMS = ["bash", "sudo", "bash-git", "my-tool", "openssh"]


@query("""WITH c AS (SELECT p_partkey, ['bash','bash-git','helper','sudo-selinux'][(p_partkey % 4 + 1)::INTEGER] AS own, ['bash','sudo','bash-git','my-tool','openssh'][(p_partkey % 5 + 1)::INTEGER] AS claim FROM part)
SELECT p_partkey, claim FROM c WHERE claim IN ('bash', 'sudo', 'openssh') AND NOT (own = claim OR starts_with(own, claim || '-') OR ends_with(own, '-' || claim))""")
def provides_antijoin(spark, d):
    own = F.get(F.array(*map(F.lit, ["bash", "bash-git", "helper", "sudo-selinux"])), (F.col("p_partkey") % 4).cast("int"))
    claim = F.get(F.array(*map(F.lit, _CLAIMS)), (F.col("p_partkey") % 5).cast("int"))
    x = _t(spark, d, "part").select("p_partkey", F.array(own).alias("names"), F.array(claim).alias("claims"))
    return x.select("p_partkey", F.explode(scan.displaced(F.col("names"), F.col("claims"))).alias("claim"))


@query("SELECT s_suppkey, regexp_replace('pkg' || s_suppkey::VARCHAR || ['-git','-bin','','-lts'][(s_suppkey % 4 + 1)::INTEGER], '-(?:git|bin|lts)$', '') AS stem FROM supplier")
def alternate_stem(spark, d):
    suffix = F.get(F.array(*map(F.lit, ["-git", "-bin", "", "-lts"])), (F.col("s_suppkey") % 4).cast("int"))
    name = F.concat(F.lit("pkg"), F.col("s_suppkey").cast("string"), suffix)
    return _t(spark, d, "supplier").select("s_suppkey", F.regexp_replace(name, rf"(?<=.)-(?:{'|'.join(scan.ALTERNATE)})$", "").alias("stem"))


# checksums: an order's lines stand for sources, and every third has no sum


@query("SELECT l_orderkey, count(*)::BIGINT AS sources, count(*) FILTER (l_linenumber % 3 = 0)::BIGINT AS unverified, CASE WHEN count(*) FILTER (l_linenumber % 3 = 0) = 0 THEN 'all' WHEN count(*) FILTER (l_linenumber % 3 = 0) = count(*) THEN 'none' ELSE 'some' END AS verified FROM lineitem GROUP BY l_orderkey")
def checksum_coverage(spark, d):
    x = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("sources"), F.count_if(F.col("l_linenumber") % 3 == 0).alias("unverified"))
    return x.withColumn("verified", F.when(F.col("unverified") == 0, "all").when(F.col("unverified") == F.col("sources"), "none").otherwise("some"))


@query("SELECT l_orderkey, count(*)::BIGINT AS sources, (count(*) + l_orderkey % 2)::BIGINT AS sums FROM lineitem GROUP BY l_orderkey HAVING l_orderkey % 2 = 1")
def checksum_count_mismatch(spark, d):
    x = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("sources"))
    return x.withColumn("sums", F.col("sources") + F.col("l_orderkey") % 2).where("sources != sums")


# indicators: first words of benchmark items

_IOC = "ioc AS (SELECT lower(regexp_extract(text, '[A-Za-z]{3,}')) AS value, min(item_id) AS item_id FROM benchmark GROUP BY 1)"


def _indicators(spark, d):
    b = _t(spark, d, "benchmark").select(F.lower(F.regexp_extract("text", "[A-Za-z]{3,}", 0)).alias("value"), "item_id")
    return b.groupBy("value").agg(F.min("item_id").alias("item_id")).where("value != ''")


def _tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9_./-]+"))).alias("value"))


@query(f"WITH {_IOC}, tok AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_./-]+')) AS value FROM documents) SELECT value, count(*)::BIGINT AS n_docs FROM tok JOIN ioc USING (value) WHERE value != '' GROUP BY value")
def ioc_token_join(spark, d):
    return _tokens(spark, d).join(_indicators(spark, d), "value").groupBy("value").agg(F.count("*").alias("n_docs"))


@query(f"""WITH {_IOC}, tok AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_./-]+')) AS value FROM documents)
SELECT CASE WHEN item_id % 3 = 0 THEN 'campaign-' || (item_id % 2)::VARCHAR END AS campaign, count(*)::BIGINT AS hits FROM tok JOIN ioc USING (value) WHERE value != '' GROUP BY 1""")
def ioc_campaign_left_join(spark, d):
    camp = _t(spark, d, "benchmark").where("item_id % 3 = 0").select("item_id", F.concat(F.lit("campaign-"), (F.col("item_id") % 2).cast("string")).alias("campaign"))
    x = _tokens(spark, d).join(_indicators(spark, d), "value").join(camp, "item_id", "left")
    return x.groupBy("campaign").agg(F.count("*").alias("hits"))


@query("WITH a AS (SELECT 'name' AS kind, n_name AS value, 'old' AS campaign_id, 0 AS src FROM nation UNION ALL SELECT 'name', n_name, 'new', 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'name', r_name, 'region', 2 FROM region) SELECT kind, value, campaign_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY src DESC) AS k FROM a) WHERE k = 1")
def ioc_merge_lastwins(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    row = lambda df, name, c: df.select(F.lit("name").alias("kind"), F.col(name).alias("value"), F.lit(c).alias("campaign_id"))
    return ioc.merge(row(n, "n_name", "old"), row(n.where("n_regionkey = 1"), "n_name", "new"), row(r, "r_name", "region"))


# dependency graphs: a part needs the parts of half and a third of its number

_EDGES = "e AS (SELECT p_partkey AS parent, p_partkey // 2 AS child FROM part UNION SELECT p_partkey, p_partkey // 3 FROM part)"
_REACH = f"WITH RECURSIVE {_EDGES}, r AS (SELECT max(p_partkey) AS name, 0 AS depth FROM part UNION SELECT e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.name WHERE e.child > 0 AND r.depth < 16), c AS (SELECT name, min(depth) AS depth FROM r GROUP BY name)"
#: The same to its end.
_REACH_ALL = _REACH.replace(" AND r.depth < 16", "")


def _closure(spark, d, max_depth=None):
    shared_dir(spark)
    p = _t(spark, d, "part")
    e = p.select(F.col("p_partkey").alias("parent"), F.explode(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3))).alias("child")).where("child > 0").distinct()
    return graph.closure(e, p.agg(F.max("p_partkey").alias("name")), max_depth), e


@query(f"{_REACH_ALL} SELECT name, depth::INTEGER AS depth FROM c")
def dep_closure(spark, d):
    return _closure(spark, d)[0]


@query(f"{_REACH} SELECT depth::INTEGER AS depth, count(*)::BIGINT AS n FROM c GROUP BY depth")
def dep_depth(spark, d):
    return _closure(spark, d, graph.MAX_DEPTH)[0].groupBy("depth").agg(F.count("*").alias("n"))


@query(f"{_REACH_ALL} SELECT count(*) FILTER (p_size % 2 = 0)::BIGINT AS orphans, count(*)::BIGINT AS nodes FROM c JOIN part ON p_partkey = name")
def orphan_count(spark, d):
    """Parts of even size have no maintainer. Numbers that no part has are no nodes."""
    nodes, e = _closure(spark, d)
    info = _t(spark, d, "part").select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") % 2 == 0, None).otherwise("someone").alias("maintainer"))
    return graph.counts(graph.annotate(nodes, info, e.withColumn("kind", F.lit("runtime")))).select("orphans", F.col("community").alias("nodes"))


@query(f"""{_REACH}, i AS (SELECT DISTINCT e.parent, e.child FROM e WHERE e.parent IN (SELECT name FROM c) AND e.child IN (SELECT name FROM c)),
dl AS (SELECT name, 0 AS layer FROM c UNION SELECT i.parent, dl.layer + 1 FROM dl JOIN i ON i.child = dl.name),
ly AS (SELECT name, max(layer) AS layer FROM dl GROUP BY name),
o AS (SELECT name, layer, row_number() OVER (ORDER BY name) AS rank FROM ly WHERE layer = 0 UNION ALL
SELECT name, layer, row_number() OVER (ORDER BY seen, name) AS rank FROM (SELECT ly.name, ly.layer, max(o.rank) AS seen FROM o JOIN i ON i.child = o.name JOIN ly ON ly.name = i.parent AND ly.layer = o.layer + 1 GROUP BY ly.name, ly.layer))
SELECT name, (row_number() OVER (ORDER BY layer, rank) - 1)::BIGINT AS place FROM o""")
def topo_order(spark, d):
    """What a package needs comes before it, in the order in which packages become free to build."""
    nodes, e = _closure(spark, d, graph.MAX_DEPTH)
    return graph.order(nodes.select(F.lit(1).alias("root"), "name"), e).select("name", F.col("place").cast("long").alias("place"))


@query()
def sbom_document(spark, d):
    nodes, e = _closure(spark, d, graph.MAX_DEPTH)
    text = lambda df, *cs: df.select(*[F.col(c).cast("string").alias(c) if c != "depth" else F.col(c) for c in cs])
    found = _hits(spark, d).withColumn("title", F.col("id")).withColumn("recommendation", F.lit("read it"))
    scans = found.groupBy("pkg_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    return report.sbom(text(nodes, "name", "depth").withColumn("origin", F.lit("community")), text(e, "parent", "child"), scans, found)


# provenance: a user is a package, a day a version, event types its markers

_DAYS = "v AS (SELECT user_id::VARCHAR AS package, strftime(ts, '%Y-%m-%d') AS version, list_sort(list(DISTINCT event_type)) AS markers FROM events GROUP BY 1, 2)"
_GAINED = f"""WITH {_DAYS}, w AS (SELECT *, lag(markers) OVER (PARTITION BY package ORDER BY version) AS was FROM v), ch AS (SELECT * FROM w WHERE was IS NULL OR was != markers),
b AS (SELECT *, lag(markers) OVER (PARTITION BY package ORDER BY version) AS before FROM ch)
SELECT package, version, array_to_string(list_sort(list_filter(markers, lambda m: NOT list_contains(before, m))), ',') AS gained FROM b WHERE before IS NOT NULL AND len(list_filter(markers, lambda m: NOT list_contains(before, m))) > 0"""


def _versions(events: DataFrame) -> DataFrame:
    v = events.groupBy(F.col("user_id").cast("string").alias("package"), F.date_format("ts", "yyyy-MM-dd").alias("version")).agg(F.array_sort(F.collect_set("event_type")).alias("markers"))
    return v.withColumn("digest", F.array_join("markers", ","))


@query(_GAINED)
def provenance_gained(spark, d):
    return provenance.gained(_versions(_t(spark, d, "events"))).withColumn("gained", F.array_join("gained", ","))


#: Files that the stream comes in.
BATCHES = 3


@query(_GAINED)
def provenance_stream(spark, d):
    """The same by keyed state over a stream of files, a batch each, so that what a package had is known from state."""
    from packsieve.session import ship
    from packsieve.streaming.provenance import gained_stream

    ship(spark)
    where = f"{shared_dir(spark)}/provenance-{uuid.uuid4().hex}"
    v = _versions(_t(spark, d, "events"))
    days = [r[0] for r in v.select("version").distinct().orderBy("version").collect()]  # a date each
    for n, day in enumerate(days[:: max(1, len(days) // BATCHES)]):
        part = v.where((F.col("version") >= day) & (F.col("version") < (days + ["~"])[min(len(days), (n + 1) * max(1, len(days) // BATCHES))]))
        part.coalesce(1).write.mode("append").parquet(f"{where}/in")
    source = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    q = gained_stream(source).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    with Workspace(spark, "stream") as work:
        work.path = where
        return settle(spark.read.schema("package string, version string, gained array<string>").parquet(f"{where}/out").withColumn("gained", F.array_join("gained", ",")))


def _markers_sql(text: str) -> str:
    """The sorted list of markers in a text."""
    shown = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower({text}), $${n}$$)' for n in needles)} THEN '{k}' END" for k, needles in provenance.MARKERS.items())
    return f"list_sort(list_filter([{shown}], lambda m: m IS NOT NULL))"


@query(f"WITH s AS ({scripts_sql()}) SELECT pkg_id, array_to_string({_markers_sql('content')}, ',') AS markers FROM s")
def provenance_markers(spark, d):
    return scripts(_t(spark, d, "documents")).select("pkg_id", F.array_join(provenance.markers(F.col("content")), ",").alias("markers"))


# verdict tables and gates


@query("SELECT event_id FROM events WHERE epoch(ts) + 86400 >= epoch(TIMESTAMP '2024-01-20')")
def verdict_ttl(spark, d):
    v = _t(spark, d, "events").select("event_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) + 86400).alias("expires_at"))
    return verdicts.live(v, 1705708800).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, sum(event_id % 97) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM events) WHERE held <= 1500")
def cache_evict_oldest(spark, d):
    e = _t(spark, d, "events").select("event_id", (F.col("event_id") % 97).alias("size"), F.col("ts").alias("modified"), F.col("user_id").alias("shard"))
    return verdicts.evict_oldest(e, 1500, tie="event_id").select("event_id")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'block' WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'block' WHEN toxic = 1 THEN 'override' ELSE 'pass' END AS outcome FROM labels")
def gate_install_outcome(spark, d):
    x = _t(spark, d, "labels")
    return x.select("doc_id", gates.install_outcome(F.col("quality").isNull(), F.col("toxic") == 1, F.col("doc_id") % 2 == 1).alias("outcome"))


@query(f"{_HITS_SQL}, g AS (SELECT pkg_id, count(*) FILTER (sev_rank = 0) AS c, count(*) FILTER (sev_rank = 1) AS h FROM hits GROUP BY pkg_id) SELECT pkg_id, CASE WHEN pkg_id::BIGINT % 50 = 0 THEN 'abort' WHEN c > 0 THEN 'abort' WHEN h > 0 THEN 'warn' ELSE 'proceed' END AS outcome FROM g")
def hook_outcome(spark, d):
    g = _hits(spark, d).groupBy("pkg_id").agg(F.count_if(F.col("sev_rank") == 0).alias("c"), F.count_if(F.col("sev_rank") == 1).alias("h"))
    return g.select("pkg_id", gates.hook_outcome(F.col("pkg_id").cast("long") % 50 == 0, F.col("c"), F.col("h")).alias("outcome"))


@query("""WITH x AS (SELECT o_orderkey % 5 AS worst, (o_orderkey // 5) % 2 = 0 AS interactive, (o_orderkey // 10) % 3 != 0 AS reviewed FROM orders)
SELECT worst, interactive, reviewed, CASE WHEN NOT reviewed THEN 'block' WHEN worst = 0 THEN (CASE WHEN interactive THEN 'typed yes' ELSE 'deny' END) WHEN worst = 1 THEN (CASE WHEN interactive THEN 'default no' ELSE 'deny' END) ELSE 'default yes' END AS answer, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def policy_matrix(spark, d):
    """Every order is a build: what a helper asks, with the number of builds."""
    k = F.col("o_orderkey")
    x = _t(spark, d, "orders").select((k % 5).alias("worst"), (F.floor(k / 5) % 2 == 0).alias("interactive"), (F.floor(k / 10) % 3 != 0).alias("reviewed"))
    x = x.withColumn("answer", gates.policy(F.col("worst"), F.col("interactive"), F.col("reviewed")))
    return x.groupBy(x.columns).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE least(100, (100 * (p_size % 5) + 50 * (p_size % 3)) // (p_partkey % 7)) END::BIGINT AS score FROM part")
def risk_score(spark, d):
    return _t(spark, d, "part").select("p_partkey", gates.risk_score(F.col("p_size") % 5, F.col("p_size") % 3, F.col("p_partkey") % 7).alias("score"))


@query("SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def hook_bodies_concat(spark, d):
    x = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("p"))
    return x.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("p", lambda q: q["t"]), "\n"), 256).alias("digest"))


# catalog

_CATALOG = "c(id, severity, category, owner) AS (VALUES " + ", ".join(f"('{e['id']}', '{e['severity']}', '{e['category']}', '{e['owner']}')" for e in catalog.entries()) + ")"


def _catalog(spark):
    return spark.createDataFrame([tuple(e.values()) for e in catalog.entries()], catalog.CATALOG_TYPE)


@query(f"{_HITS_SQL}, {_CATALOG}, k AS (SELECT category, count(*)::BIGINT AS n, count(*) FILTER (owner = 'builtin')::BIGINT AS n_pattern FROM c GROUP BY category) SELECT k.*, (SELECT count(*) FROM hits h WHERE h.category = k.category)::BIGINT AS n_hits FROM k")
def catalog_by_category(spark, d):
    """The catalog by category, with the hits of each in the scripts."""
    listed = _catalog(spark).groupBy("category").agg(F.count("*").alias("n"), F.count_if("pattern_based").alias("n_pattern"))
    hits = _hits(spark, d).groupBy("category").agg(F.count("*").alias("n_hits"))
    return listed.join(hits, "category", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))


@query(f"{_HITS_SQL}, {_CATALOG} SELECT h.id, (SELECT count(*) FROM c WHERE c.id = h.id)::BIGINT AS n, count(*)::BIGINT AS n_hits FROM hits h GROUP BY h.id")
def catalog_duplicates(spark, d):
    """Each code that scripts give, with its entries in the catalog, of which there should be one."""
    known = _catalog(spark).groupBy("id").agg(F.count("*").alias("n"))
    return _hits(spark, d).groupBy("id").agg(F.count("*").alias("n_hits")).join(known, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "n_hits")


@query("SELECT ['npm', 'file', 'domain'][(c_custkey % 3 + 1)::INTEGER] AS kind, count(*)::BIGINT AS n, count(DISTINCT c_nationkey)::BIGINT AS campaigns FROM customer GROUP BY 1")
def ioc_stats(spark, d):
    """Customers are indicators of three kinds, their nations campaigns."""
    kind = F.get(F.array(*map(F.lit, ["npm", "file", "domain"])), (F.col("c_custkey") % 3).cast("int"))
    return ioc.stats(_t(spark, d, "customer").select(kind.alias("kind"), F.col("c_name").alias("value"), F.col("c_nationkey").cast("string").alias("campaign_id")))


from packsieve.plans import checks, tables  # noqa: E402, F401  further queries, which use what is defined above
