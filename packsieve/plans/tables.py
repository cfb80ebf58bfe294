"""Registered queries of whole packages, streams, stored tables, graphs of many roots, and rules that people write."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from packsieve.operators import graph, ioc, metadata, provenance, rulebook, scan, verdicts
from packsieve.plans.queries import _EDGES, _PHYSICAL, _RULES_SQL, _SHARED, _markers_sql, _prior, _quoted, _scanned, _t, query
from packsieve.sources import baseline, dumps, packages
from packsieve.sources.scripts import PAYLOADS, scripts, scripts_sql
from packsieve.store import Workspace, settle

# lines that the engine takes for messages

_MESSAGE = r"""regexp_matches(line, '^\s*(echo|printf|print|note|msg|msg2|warning|plain|error)([ \t]|$)') AND NOT regexp_matches(line, '[;|&>`]|\$\(')"""


@query(f"{_PHYSICAL}, {_RULES_SQL} SELECT p.pkg_id, r.id, count(*)::BIGINT AS n_lines FROM p JOIN rules r ON regexp_matches(p.line, r.pattern) WHERE NOT ltrim(p.line) LIKE '#%' AND NOT ({_MESSAGE}) GROUP BY p.pkg_id, r.id")
def live_rule_lines(spark, d):
    """Rules over the lines that the engine parsed itself, its own flags of comments and messages included."""
    found = _scanned(spark, d, lambda c: scan.rule_matches(c.lines, _SHARED).where("variant = 'raw'"), _SHARED, ("lines",))
    return found.groupBy("pkg_id", "id").agg(F.count("*").alias("n_lines"))


@query(f"{_PHYSICAL} SELECT pkg_id, count(*)::BIGINT AS n_messages FROM p WHERE {_MESSAGE} GROUP BY pkg_id")
def message_lines(spark, d):
    return _scanned(spark, d, lambda c: c.lines.where("is_info").groupBy("pkg_id").agg(F.count("*").alias("n_messages")), parts=("lines",))


# provenance of packages of two files


def _hook(docs, shift):
    line = F.get(F.array(*map(F.lit, PAYLOADS)), ((F.floor(F.col("doc_id") / 2) + shift) % len(PAYLOADS)).cast("int"))
    return docs.select(F.col("doc_id").cast("string").alias("pkg_id"), F.lit("install_script").alias("file_type"), F.lit("a.install").alias("file"), F.concat(F.lit("post_install() {\n"), line, F.lit("\n}\n")).alias("content"))


def _hook_sql(shift: int) -> str:
    return f"'post_install() {{' || chr(10) || ([{', '.join(map(_quoted, PAYLOADS))}])[((doc_id // 2 + {shift}) % {len(PAYLOADS)} + 1)::INTEGER] || chr(10) || '}}' || chr(10)"


_PACKAGES = f"""WITH a AS (SELECT *, {_hook_sql(3)} AS hook FROM ({scripts_sql()})), b AS (SELECT *, {_hook_sql(4)} AS hook FROM ({scripts_sql(5)})),
pairs AS (SELECT a.doc_id, a.pkg_id, CASE WHEN a.doc_id % 3 = 0 THEN b.content ELSE a.content END || chr(10) || CASE WHEN a.doc_id % 3 = 0 THEN b.hook ELSE a.hook END AS now, b.content || chr(10) || b.hook AS was FROM a JOIN b USING (doc_id))"""


def _packages(spark, d):
    """(now, before): recipes with hooks; every third package did not change."""
    docs = _t(spark, d, "documents")
    old = _prior(spark, d).unionByName(_hook(docs, 4))
    same = F.col("pkg_id").cast("long") % 3 == 0
    return old.where(same).unionByName(scripts(docs).unionByName(_hook(docs, 3)).where(~same)), old


@query(f"""{_PACKAGES}, m AS (SELECT pkg_id, list_filter({_markers_sql('now')}, lambda x: NOT list_contains({_markers_sql('was')}, x)) AS gained FROM pairs)
SELECT pkg_id, array_to_string(list_transform(gained, lambda x: MAP {{{', '.join(f"'{k}': '{v}'" for k, v in provenance.LABELS.items())}}}[x]), ', ') AS detail FROM m WHERE len(gained) > 0""")
def provenance_packages(spark, d):
    """PROV-001 of packages of a recipe and a hook, as one text each."""
    now, old = _packages(spark, d)
    state, _ = provenance.known_state(provenance.stored(provenance.snapshots(old, F.lit("then"))))
    return provenance.findings(provenance.snapshots(now, F.lit("now")), state).select("pkg_id", "detail")


@query(f"{_PACKAGES} SELECT pkg_id, array_to_string({_markers_sql('now')}, ',') AS markers, CASE WHEN now = was THEN 'then' ELSE 'now' END AS last_seen FROM pairs")
def stored_baseline(spark, d):
    """A baseline that is written, brought up to date under its manifest, and read again."""
    now, old = _packages(spark, d)
    with Workspace(spark, "baseline") as work:
        baseline.update(provenance.snapshots(old, F.lit("then")), work.path)
        baseline.update(provenance.snapshots(now, F.lit("now")), work.path)
        state, _ = baseline.load(spark, work.path)
        return settle(state.select(F.col("package").alias("pkg_id"), F.array_join("markers", ",").alias("markers"), "last_seen"))


# rules that people write

#: Expressions, and whether an engine that tries all ways may take without end: told by hand. # stands for a word of the table.
_EXPRESSIONS = [
    ("#", False), ("((?:#)+)+$", True), (r"#\s+\w+", False), ("(a|a)*#", True), (r"(?:#\s?)*$", False), (r"(\w+\s?)*#", True), (".*#.*", False), (".*.*.*.*.*.*.*.*.*.*#", True), (r"(\S+\s+)*#", False), ("(?>#+)+", False), (r"(#)\1", True), ("(#", True), (r"([a-z]+\.)+#", False),
]


@query(f"SELECT p_partkey, [{', '.join(str(x).lower() for _, x in _EXPRESSIONS)}][(p_partkey % {len(_EXPRESSIONS)} + 1)::INTEGER] AS refused FROM part")
def rule_costs(spark, d):
    """A table of rules, each judged by its expression."""
    word = F.substring_index("p_name", " ", 1)
    pattern = F.replace(F.get(F.array(*[F.lit(p) for p, _ in _EXPRESSIONS]), (F.col("p_partkey") % len(_EXPRESSIONS)).cast("int")), F.lit("#"), word)
    return rulebook.costs(_t(spark, d, "part").select("p_partkey", pattern.alias("pattern"))).select("p_partkey", F.col("refused").isNotNull().alias("refused"))


_RECIPE = ["pkgname=p", "\npkgver=1\npkgrel=1\n_site=https://", ".example/\nbuild() {\n  # make none\n  ", "\n}\npackage() {\n  make install\n}\n"]
_STRUCTURES = """
[[rule]]
id = "FUN-001"
name = "Units enabled while building"
severity = "medium"
category = "persistence"
recommendation = "-"
[[rule.patterns]]
type = "function"
name = "^build$"
body_pattern = "SYSTEMCTL +enable"
[[rule.patterns]]
type = "function"
name = "^(package|check)$"
[[rule.patterns]]
type = "variable"
name = "_site"
value_pattern = "brand#1"
"""


@query(f"""WITH x AS (SELECT p_partkey, p_brand, ([{', '.join(map(_quoted, PAYLOADS))}])[(p_partkey % {len(PAYLOADS)} + 1)::INTEGER] AS line FROM part)
SELECT p_partkey, 0 AS pat_idx, 'build' AS name FROM x WHERE line LIKE 'systemctl enable%' UNION ALL SELECT p_partkey, 1, 'package' FROM x UNION ALL SELECT p_partkey, 2, '_site' FROM x WHERE p_brand LIKE 'Brand#1%'""")
def function_rules(spark, d):
    """Rules on functions and variables over recipes made of parts."""
    line = F.get(F.array(*map(F.lit, PAYLOADS)), (F.col("p_partkey") % len(PAYLOADS)).cast("int"))
    content = F.concat(F.lit(_RECIPE[0]), F.col("p_partkey").cast("string"), F.lit(_RECIPE[1]), "p_brand", F.lit(_RECIPE[2]), line, F.lit(_RECIPE[3]))
    part = packages.spread(_t(spark, d, "part").select("p_partkey", "p_brand"))  # a short table that makes long files
    files = part.select(F.col("p_partkey").cast("string").alias("pkg_id"), F.lit("pkgbuild").alias("file_type"), F.lit("PKGBUILD").alias("file"), content.alias("content"))
    rules = rulebook.read_toml(_STRUCTURES)
    with Workspace(spark, "functions") as work:
        ctx = scan.Context(files, work, rules, ("record", "bodies"))
        found = scan.structure_matches(ctx.bodies, ctx.packages, rules)
        return settle(found.select(F.col("pkg_id").cast("long").alias("p_partkey"), "pat_idx", F.col("snippet").alias("name")))


# domains

_SITES = ["example.org", "m.thththe.example.net", "example.net.evil", "ththth.example.net"]


@query(f"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages), s(value) AS (VALUES {', '.join(f"('{x}')" for x in _SITES)})
SELECT page_id, value FROM u JOIN s ON host = value OR ends_with(host, '.' || value)""")
def domain_indicators(spark, d):
    """IOC-001 of domains: hosts of pages, disguised in every other page, with another domain in the path."""
    url = F.concat(F.lit("see "), "url", F.lit("/example.net.evil now"))
    text = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(F.regexp_replace(url, r"\.", "[.]"), "see http", "see hxxp")).otherwise(url)
    texts = _t(spark, d, "pages").select(F.col("page_id").alias("pkg_id"), F.lit("pkgbuild").alias("file_type"), F.lit("f").alias("file"), text.alias("masked"), text.alias("masked_plain"))
    table = spark.createDataFrame([("domain", x, "c") for x in _SITES], ioc.INDICATOR_TYPE)
    return ioc.hits(texts, table).select(F.col("pkg_id").alias("page_id"), F.col("snippet").alias("value"))


# graphs of many roots: a part needs the parts of half and a third of its number

_ROOTS = "SELECT p_partkey AS root FROM part WHERE p_partkey % 211 = 1"


def _graph(spark, d):
    p = _t(spark, d, "part")
    e = p.select(F.col("p_partkey").alias("parent"), F.explode(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3))).alias("child")).where("child > 0").distinct()
    return settle(e), p.where("p_partkey % 211 = 1").select(F.col("p_partkey").alias("root"))


def _reach_sql(where: str = "true", depth: int = 16) -> str:
    return f"""WITH RECURSIVE {_EDGES}, r AS (SELECT root, root AS name, 0 AS depth FROM ({_ROOTS}) UNION SELECT r.root, e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.name WHERE e.child > 0 AND r.depth < {depth} AND {where}),
c AS (SELECT root, name, min(depth)::INTEGER AS depth FROM r GROUP BY root, name)"""


@query(f"{_reach_sql('r.name % 7 != 3', 9)} SELECT root, name, depth FROM c")
def root_closures(spark, d):
    """Closures of many roots, nine levels deep; names whose number is 3 modulo 7 are opaque."""
    e, roots = _graph(spark, d)
    opaque = _t(spark, d, "part").where("p_partkey % 7 = 3").select(F.col("p_partkey").alias("name"))
    return graph.closures(e, roots, 9, None, opaque)


@query(f"""{_reach_sql()}, n AS (SELECT root, depth, count(*) AS n FROM c GROUP BY root, depth), s AS (SELECT root, depth, coalesce(sum(n) OVER (PARTITION BY root ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT c.root, c.name, c.depth FROM c JOIN s ON s.root = c.root AND s.depth = c.depth WHERE s.before < 25""")
def closure_bounds(spark, d):
    """The same with a bound of 25 names: no level starts at that many."""
    return graph.closures(*_graph(spark, d), max_nodes=25)


@query(f"""{_reach_sql()}, i AS (SELECT DISTINCT c.root, e.parent, e.child FROM c JOIN e ON e.parent = c.name JOIN c k ON k.root = c.root AND k.name = e.child),
dl AS (SELECT root, name, 0 AS layer FROM c UNION SELECT i.root, i.parent, dl.layer + 1 FROM dl JOIN i ON i.child = dl.name AND i.root = dl.root),
ly AS (SELECT root, name, max(layer) AS layer FROM dl GROUP BY root, name),
o AS (SELECT root, name, layer, row_number() OVER (PARTITION BY root ORDER BY name) AS rank FROM ly WHERE layer = 0 UNION ALL
SELECT root, name, layer, row_number() OVER (PARTITION BY root ORDER BY seen, name) AS rank FROM (SELECT ly.root, ly.name, ly.layer, max(o.rank) AS seen FROM o JOIN i ON i.child = o.name AND i.root = o.root JOIN ly ON ly.name = i.parent AND ly.root = i.root AND ly.layer = o.layer + 1 GROUP BY ly.root, ly.name, ly.layer))
SELECT root, name, (row_number() OVER (PARTITION BY root ORDER BY layer, rank) - 1)::INTEGER AS place FROM o""")
def root_orders(spark, d):
    """What each root's packages are built in."""
    e, roots = _graph(spark, d)
    return graph.order(graph.closures(e, roots, max_nodes=None), e)


@query("""WITH p AS (SELECT p_partkey AS parent, CASE p_partkey % 3 WHEN 0 THEN p_partkey // 2 ELSE -1 - p_size END AS child FROM part), g AS (SELECT -1 - p_size AS child, p_partkey AS provider, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS k FROM part WHERE p_partkey % 4 = 0)
SELECT DISTINCT p.parent, coalesce((SELECT provider FROM g WHERE g.child = p.child AND g.provider != p.parent ORDER BY k LIMIT 1), p.child) AS child FROM p""")
def resolved_providers(spark, d):
    """Virtual names (here numbers below 0, by size) lead to the dearest part that provides them."""
    k = F.col("p_partkey")
    part = _t(spark, d, "part")
    edges = part.select(k.cast("string").alias("parent"), F.when(k % 3 == 0, F.floor(k / 2)).otherwise(-1 - F.col("p_size")).cast("string").alias("child"))
    info = part.select(F.format_string("%d", k).alias("name"), F.when(k % 4 == 0, F.array((-1 - F.col("p_size")).cast("string"))).otherwise(F.array().cast("array<string>")).alias("provides"), F.struct("p_retailprice", (-k).alias("k")).alias("rank"))
    return graph.resolve_provides(edges, info, "rank").select(F.col("parent").cast("long").alias("parent"), F.col("child").cast("long").alias("child"))


@query("SELECT c_custkey AS name, coalesce(n > 0, false) AS requested FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1) ON o_custkey = c_custkey AND c_custkey % 4 = 0")
def local_requests(spark, d):
    """Local folders (customers) of which those are asked for that stand among the targets (some orders'), the others only
    shadow a name."""
    targets = _t(spark, d, "orders").where("o_orderkey % 4 = 0 and o_custkey % 4 = 0").select(F.col("o_custkey").alias("name"))
    return metadata.requested(targets, _t(spark, d, "customer").select(F.col("c_custkey").alias("name")))


# stored tables


@query("SELECT event_id FROM (SELECT event_id, sum(event_id % 97) OVER (ORDER BY ts DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM events) WHERE held <= 100000")
def cache_evict_total(spark, d):
    """One limit for a whole cache."""
    e = _t(spark, d, "events").select("event_id", (F.col("event_id") % 97).alias("size"), F.col("ts").alias("modified"))
    return verdicts.evict_oldest_of_all(e, 100000, tie="event_id").select("event_id")


@query("SELECT 'p' || p_partkey::VARCHAR AS name, p_size AS votes, p_retailprice AS popularity, len(p_name) - len(replace(p_name, ' ', '')) + 1 AS n_depends FROM part WHERE p_partkey % 5 != 0 OR p_size > 25")
def package_dumps(spark, d):
    """Metadata written as dumps and read again by the data source."""
    dumps.register(spark)
    p = _t(spark, d, "part")
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    rows = p.select(name.alias("Name"), F.lit("1").alias("Version"), name.alias("PackageBase"), F.col("p_size").alias("NumVotes"), F.col("p_retailprice").alias("Popularity"), F.split("p_name", " ").alias("Depends"), F.col("p_partkey").alias("k"))
    with Workspace(spark, "dumps") as work:
        rows.where("k % 2 = 0").drop("k").write.json(f"{work.path}/even")
        rows.where("k % 2 = 1").drop("k").write.option("compression", "gzip").json(f"{work.path}/odd")
        read = spark.read.format("package_dumps").load(work.path)
        return settle(read.where("cast(substr(name, 2) as long) % 5 != 0 or votes > 25").select("name", "votes", "popularity", F.size("depends").cast("long").alias("n_depends")))


# streams

_DAY = "user_id::VARCHAR || '/' || strftime(ts, '%Y-%m-%d')"


@query(f"""SELECT {_DAY} AS transaction, count(DISTINCT event_type)::BIGINT AS n_targets, ['proceed', 'warn', 'abort'][max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) + 1] AS outcome FROM events GROUP BY 1""")
def transaction_stream(spark, d):
    """A user's day is a transaction and its kinds of events are targets, which come in batches that part days in two."""
    from packsieve.streaming import feed

    e = _t(spark, d, "events")
    told = e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("transaction"), F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("at"))
    kinds = [("error", "abort"), ("click", "warn"), ("view", "proceed"), ("login", "proceed"), ("logout", "proceed"), ("signup", "proceed"), ("search", "proceed")]
    at = F.unix_micros("at")
    first, last = told.agg(F.min(at), F.max(at)).first()
    with Workspace(spark, "feed") as work:
        for n in range(3):
            third = F.least(F.floor((at - first) * 3 / (last - first + 1)), F.lit(2))
            told.where(third == n).coalesce(1).write.mode("append").parquet(f"{work.path}/in")
        end = told.limit(1).select(F.lit("end").alias("transaction"), F.lit("view").alias("name"), F.timestamp_micros(F.lit(last + 30 * 86_400_000_000)).alias("at"))
        end.coalesce(1).write.mode("append").parquet(f"{work.path}/in")
        source = spark.readStream.schema(told.schema).option("maxFilesPerTrigger", 1).parquet(f"{work.path}/in")
        verdict = lambda: spark.createDataFrame(kinds, "name string, outcome string")
        feed.session_outcomes(source, verdict, f"{work.path}/out", f"{work.path}/state-{uuid.uuid4().hex}", gap_ms=86_400_000).awaitTermination()
        return settle(spark.read.parquet(f"{work.path}/out/outcomes").where("transaction != 'end'").select("transaction", "n_targets", "outcome"))
