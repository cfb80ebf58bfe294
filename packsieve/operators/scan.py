"""The scan: package files to findings.

``files`` has a row per file: pkg_id, file_type (pkgbuild or install_script), file, content. Text state machines run
once a file, all in one Arrow pass (``parse``); all else is columns. A package's own checks need no shuffle: they are one
array of structs per package row. Lines are matched by generated literal patterns; a pattern is tried only on lines that
hold one of the pieces it needs, which are derived from the pattern.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from packsieve.functions import neturl, recipe, textnorm
from packsieve.functions.needles import clauses, needles
from packsieve.functions.severity import RANK, at_least
from packsieve.operators import catalog
from packsieve.operators.catalog import FREE_INTERPRETER, FREE_SHELL, INTERPRETER, RULES, SHELL
from packsieve.session import ship
from packsieve.store import Workspace

#: ``groups``: digests of the pattern groups (see ``pattern_groups``) whose pieces are in the line, behind the digest of all
#: the groups that were looked for.
LINE_TYPE = "array<struct<line_no:int,raw:string,deobf:string,resolved:string,is_comment:boolean,is_info:boolean,groups:array<int>>>"
HIT_TYPE = "struct<id:string,severity:string,file:string,line:int,column:int,snippet:string,detail:string,ord:int>"
FINDING_COLUMNS = ["pkg_id", "id", "sev_rank", "severity", "category", "title", "file", "line", "column", "snippet", "detail", "recommendation", "cwe_id", "analyzer_ord", "ord", "pat_idx"]

#: Package names that only their own alternates may claim.
TRUSTED = [
    "bash", "coreutils", "glibc", "gcc-libs", "systemd", "systemd-libs", "util-linux", "shadow", "filesystem", "pacman", "sudo", "doas", "openssh",
    "gnupg", "pam", "grep", "sed", "gawk", "tar", "gzip", "xz", "zstd", "findutils", "which", "less", "procps-ng", "psmisc", "iproute2", "iputils",
    "e2fsprogs", "krb5", "curl", "wget", "openssl", "ca-certificates", "ca-certificates-mozilla", "zlib", "readline", "ncurses", "dbus", "polkit",
    "systemd-sysvcompat", "linux", "linux-firmware", "mkinitcpio", "grub", "pacman-mirrorlist", "archlinux-keyring", "apparmor", "firejail", "ufw",
    "nftables", "iptables", "audit", "usbguard", "fail2ban", "clamav", "firewalld", "opensnitch", "selinux", "tomb",
]
#: Files that grant access or run as root.
SENSITIVE_BACKUP = [
    "etc/sudoers", "etc/ssh/", "etc/pam.d/", "etc/ld.so.preload", "etc/ld.so.conf", "etc/profile", "etc/shadow", "etc/passwd", "etc/group",
    "etc/gshadow", "etc/crontab", "etc/cron.d/", "etc/polkit-1/", "etc/systemd/system/", "etc/modprobe.d/", "etc/sysctl.d/", "etc/security/",
    "root/.ssh/", "etc/skel/",
]
#: Suffixes of alternate packages.
ALTERNATE = ["git", "bin", "svn", "hg", "bzr", "cvs", "nightly", "beta", "rc", "dev", "devel", "debug", "legacy", "lts", "stable", "unstable"]
#: Parts of source URLs.
SUSPICIOUS = ["pastebin.com", "paste.ee", "hastebin.com", "0x0.st", "transfer.sh", ".tk", ".ml", ".ga", ".cf"]
SHORTENERS = ["bit.ly", "t.co", "goo.gl", "tinyurl.com", "is.gd", "cli.gs", "ow.ly"]
SUM_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128, "b2": 128}

#: What fetches and runs, decodes, executes, and sets special modes.
_FETCH = r"\b(?:curl|wget|aria2c|fetch)\b"
_NEAR = r"(?:curl|wget|fetch)\b"
REMOTE_EXEC_PARTS = [
    f"(?i){p}"
    for p in [
        rf"{_FETCH}.*\|\s*{SHELL}", rf"{_FETCH}.*\|\s*{INTERPRETER}", rf"{FREE_SHELL}\s+<\(\s*{_NEAR}", rf"{FREE_INTERPRETER}\s+<\(\s*{_NEAR}",
        rf"{FREE_INTERPRETER}[^\n|]*?(?:\$\(\s*(?:curl|wget|aria2c|fetch|http)|<<<.*\$\(\s*(?:curl|wget|fetch))",
        rf"source\s+<\(\s*{_NEAR}", rf"\beval\s+[\"']?\$\(\s*{_NEAR}", rf"\.\s+<\(\s*{_NEAR}",
    ]
]
DECODES_PARTS = [
    r"(?i)base64\s+(?:-d|--decode|-[a-z]*d)", r"(?i)xxd\s+-r", r"(?i)\bbase32\s+-d", r"(?i)openssl\s+enc\s+.*-d", r"(?i)(?:gunzip|zcat)\b", r"(?i)xz\s+-d\b", r"(?i)\bunzip\b",
    r"(?i)\btr\s+.*\|", r"(?i)(?-i:(?:\\x[0-9a-fA-F]{2}){4,})",
]
EXECUTES_PARTS = [rf"(?i)\|\s*{SHELL}", r"(?i)\beval\b", rf"(?i){FREE_SHELL}\s+-c\b", rf"(?i){FREE_SHELL}\s*<<<", r"(?i)source\s+/dev/stdin", r"(?i)/dev/stdin"]
#: The same as one expression each.
REMOTE_EXEC, DECODES, EXECUTES = ("(?i)" + "|".join(p.removeprefix("(?i)") for p in parts) for parts in (REMOTE_EXEC_PARTS, DECODES_PARTS, EXECUTES_PARTS))
BLOB = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{200,}={0,2}"
SPECIAL_MODE = r"(?i)chmod\s+(?:-[a-z]+\s+)*0?[2-7][0-7]{3}\b|chmod\s+[ugoa]*[-+=][rwxt]*s\b|install\s.*-[a-z]*m[=\s]?0?[2-7][0-7]{3}\b"


def _sql(text: str) -> str:
    """A SQL string literal; ``${`` is split, as SQL texts have variables in that form replaced."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("${", "$' || '{") + "'"


BODY_TYPE = "array<struct<name:string,line_start:int,body:string,code:string,recipe:boolean>>"
PARSED_TYPE = (
    f"pkg_id string, file_type string, file string, lines {LINE_TYPE}, record struct<{recipe.RECIPE_TYPE.replace(' ', ':')}>, bodies {BODY_TYPE}, "
    "code string, plain string, masked string, masked_plain string"
)
#: What a file can be parsed for: the columns of ``PARSED_TYPE`` that have to be made.
PARTS = ("lines", "record", "bodies", "code", "plain", "masked", "masked_plain")
#: Files, and bytes of them, parsed before a batch of results is handed on. A longer file is one of its own.
FILES_A_BATCH, BYTES_A_BATCH = 64, 4 << 20
#: Files sent to a Python worker at once, where a session's usual number is of rows shorter than files are.
FILES_SENT = 128


def pattern_groups(rules: list[catalog.Rule]) -> list[tuple[str, ...]]:
    """The distinct sets of pieces that patterns of ``rules`` need; the empty set is of patterns that need none."""
    return sorted({needles(p) for r in rules if r.enabled for _, p in r.regexes()})


def group_digest(groups) -> int:
    """What names a list of groups: lines that were parsed for other rules can be told."""
    return zlib.crc32(repr(groups).encode()) - (1 << 31)


@functools.lru_cache(8)
def _users(groups: tuple[tuple[str, ...], ...]) -> tuple[list[int], list[tuple[str, tuple[int, ...]]], str]:
    """What a line without pieces gets, each piece with the places of the groups that need it, and an expression of all pieces."""
    users: dict[str, list[int]] = {}
    for k, g in enumerate(groups):
        for p in g:
            users.setdefault(p, []).append(k)
    return [group_digest(list(groups)), *(k for k, g in enumerate(groups) if not g)], [(p, tuple(ks)) for p, ks in users.items()], "|".join(map(re.escape, users))


def with_groups(lines: list[dict], groups: list[tuple[str, ...]]) -> list[dict]:
    """Lines, of one file or several, each with the digest of ``groups`` and the places of those that it may match. One
    automaton of all pieces passes by the lines that hold none."""
    texts = ["\n".join(filter(None, (x["raw"], x["deobf"], x["resolved"]))).lower() for x in lines]
    none, users, any_piece = _users(tuple(groups))
    some = pc.match_substring_regex(pa.array(texts, pa.string()), any_piece).to_pylist() if users else [False] * len(texts)
    for x, t, found in zip(lines, texts, some, strict=True):
        x["groups"] = [none[0], *sorted(set(none[1:]).union(*[ks for p, ks in users if p in t]))] if found else none
    return lines


def parse_file(file_type: str, content: str, groups: list[tuple[str, ...]] | None, parts: tuple[str, ...] = PARTS) -> dict:
    """What the scan needs of one file: its lines, record, functions or hooks, and texts, as far as ``parts`` ask for them.
    Without ``groups`` the lines have none yet."""
    out: dict = {}
    recipe_file, wanted = file_type == "pkgbuild", set(parts)
    if wanted & {"record", "bodies"}:
        record = recipe.parse_recipe(content) if recipe_file else None
        found = (record or {}).get("functions", []) if recipe_file else recipe.parse_hooks(content) if file_type == "install_script" else []
        out["record"] = record and record | {"variables": list(record["variables"].items())}
        out["bodies"] = [{"name": f["name"], "line_start": f["line_start"], "body": f["body"], "code": textnorm.executable_body(f["body"]), "recipe": recipe_file} for f in found]
    told = textnorm.flagged(content) if wanted - {"record", "bodies"} else None
    if "lines" in wanted:
        out["lines"] = textnorm.variants(content, told)
        if groups is not None:
            with_groups(out["lines"], groups)
    if wanted & {"code", "plain"}:
        out["code"] = textnorm.executable_body(content, told)
        out["plain"] = textnorm.deobfuscate_text(out["code"])
    if wanted & {"masked", "masked_plain"}:
        out["masked"] = textnorm.masked(content, told)
        out["masked_plain"] = textnorm.deobfuscate_text(out["masked"])
    return {k: out[k] for k in parts}


def _portions(whole: pa.RecordBatch):
    """A batch of files in parts of bounded size, which take some twelve times their bytes while they are parsed."""
    sizes, start, held_bytes = pc.binary_length(whole.column(3)).to_pylist(), 0, 0
    for n, size in enumerate(sizes):
        if n > start and (n - start == FILES_A_BATCH or held_bytes + (size or 0) > BYTES_A_BATCH):
            yield whole.slice(start, n - start)
            start, held_bytes = n, 0
        held_bytes += size or 0
    if start < len(sizes):
        yield whole.slice(start)


def _parser(schema: pa.Schema, groups: list[tuple[str, ...]]):
    parts = tuple(schema.names[3:])

    def run(batches):
        for whole in batches:
            for b in _portions(whole):
                found = [parse_file(t, c or "", None, parts) for t, c in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
                if "lines" in parts:
                    with_groups([x for f in found for x in f["lines"]], groups)
                made = [pa.array([x[f.name] for x in found], f.type) for f in list(schema)[3:]]
                yield pa.RecordBatch.from_arrays([*(b.column(k).cast(schema.field(k).type) for k in range(3)), *made], schema=schema)

    return run


def parse(files: DataFrame, rules: list[catalog.Rule] = RULES, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """One row per file, whatever its size, as ``PARSED_TYPE`` with the columns of ``parts``, in one pass."""
    ship(files.sparkSession)
    rows = readable(files).select("pkg_id", "file_type", "file", "content")
    kind = StructType([f for f in StructType.fromDDL(PARSED_TYPE) if f.name in ("pkg_id", "file_type", "file", *parts)])
    return rows.mapInArrow(_parser(to_arrow_schema(kind), pattern_groups(rules)), kind)


def readable(files: DataFrame) -> DataFrame:
    return files.where("content is not null")


def unscanned(files: DataFrame) -> DataFrame:
    """Files that are not scanned, or hold nothing to scan: what a gate must count as failures. Those over the limit of
    ``packages.read_tree`` come without content."""
    bad = F.when(F.col("content").isNull(), "unreadable").when((F.col("file_type") == "pkgbuild") & (F.trim("content") == ""), "empty recipe")
    return files.select("pkg_id", "file", bad.alias("reason")).where("reason is not null")


@dataclass
class Context:
    """The tables of a scan, all taken from one table of parsed files. With a workspace that table is written and read
    again, and its readers take only the columns they need; without one it is kept by the session. Files are parsed for
    ``parts`` alone: tables of other columns can't be asked for."""

    files: DataFrame
    work: Workspace | None = None
    rules: list[catalog.Rule] = field(default_factory=lambda: RULES)
    parts: tuple[str, ...] = PARTS

    @cached_property
    def parsed(self) -> DataFrame:
        rows = parse(self.files, self.rules, self.parts)
        if not self.work:
            return rows.persist()
        conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        told = conf.get(key)
        conf.set(key, FILES_SENT)
        try:
            return self.work.table(rows, "parsed")
        finally:
            conf.set(key, told)

    @property
    def lines(self) -> DataFrame:
        """The fact table: a row per logical line with its variants and flags."""
        return self.parsed.select("pkg_id", "file_type", "file", F.inline("lines"))

    @property
    def packages(self) -> DataFrame:
        return self.parsed.where("record is not null").select("pkg_id", "file", "record.*")

    @property
    def bodies(self) -> DataFrame:
        """Functions of recipes and hooks, with their executable code."""
        return self.parsed.select("pkg_id", "file", F.inline("bodies"))

    @property
    def texts(self) -> DataFrame:
        return self.parsed.select("pkg_id", "file_type", "file", "code", "plain", "masked", "masked_plain")

    def unpersist(self) -> None:
        if not self.work and "parsed" in self.__dict__:
            self.parsed.unpersist()


def _hit(id_, severity, file=None, line=None, column=None, snippet=None, detail=None, ord_=0) -> Column:
    lit = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(
        lit(id_, "string").alias("id"), lit(severity, "string").alias("severity"), lit(file, "string").alias("file"), lit(line, "int").alias("line"),
        lit(column, "int").alias("column"), lit(snippet, "string").alias("snippet"), lit(detail, "string").alias("detail"), lit(ord_, "int").alias("ord"),
    )


def _byte_column(text: Column, pattern: Column) -> Column:
    at = F.regexp_instr(text, pattern)
    return (F.octet_length(F.substring(text, F.lit(1), at - 1)) + 1).cast("int")


def held(text: str, pieces: tuple[str, ...]) -> str:
    """The SQL condition that a lower-case text holds one of the pieces; true without pieces."""
    return "(" + (" OR ".join(f"contains({text}, {_sql(p)})" for p in pieces) or "true") + ")"


def may_match(text: str, pattern: str) -> Column:
    """A cheap condition that every text matching the pattern meets."""
    return F.expr(held(f"lower({text})", needles(pattern)))


def any_part(text: str, parts: list[str]) -> Column:
    """Whether one of the expressions finds something in a text; each is tried on texts that hold all the pieces it needs."""
    tests = [f"({' AND '.join(held('_l', pieces) for pieces in clauses(p)) or 'true'} AND {text} RLIKE {_sql(p)})" for p in parts]
    return F.expr(f"coalesce(exists(array(lower({text})), _l -> {' OR '.join(tests)}), false)")


def rule_matches(line_table: DataFrame, rules: list[catalog.Rule] | None = None, gated: bool = True) -> DataFrame:
    """One row per (line, rule, pattern) that matches; the first of raw, deobf and resolved counts.

    A line meets the patterns of its groups, as the parse of its file told them. Lines that were parsed for other rules, and
    those of other tables, are searched for the pieces here.
    """
    rules = [r for r in (RULES if rules is None else rules) if r.enabled]
    live, told_groups = line_table.where("not is_comment and not is_info"), gated and "groups" in line_table.columns
    low = F.lower(F.concat_ws("\n", "raw", "deobf", "resolved"))
    if told_groups:
        all_groups = pattern_groups(rules)
        place, own = {g: k for k, g in enumerate(all_groups)}, F.get("groups", F.lit(0)) == group_digest(all_groups)
        live = live.where(~own | (F.size("groups") > 1)).withColumn("_groups", F.when(own, F.slice("groups", 2, 1 << 30))).withColumn("_low", F.when(~own, low))
    else:
        live = live.withColumn("_low", low)
    gate = lambda pieces: f"coalesce(array_contains(_groups, {place[pieces]}), {held('_low', pieces)})" if told_groups else held("_low", pieces)
    known, groups = [], {}
    for n, r in enumerate(rules):
        types = ", ".join(f"'{t}'" for t in r.file_types)
        for i, p in r.regexes():
            known.append((n, i, r.id, r.severity, p))
            tests = " ".join(f"WHEN {v} RLIKE {_sql(p)} THEN named_struct('ord', {n}, 'pat_idx', {i}, 'variant', '{v}')" for v in ("raw", "deobf", "resolved"))
            groups.setdefault(needles(p) if gated else (), []).append(f"CASE WHEN file_type NOT IN ({types}) THEN NULL {tests} END")
    hits = ", ".join(f"CASE WHEN {gate(pieces)} THEN array({', '.join(cases)}) END" for pieces, cases in groups.items())
    found = F.expr(f"array_compact(flatten(array_compact(array({hits}))))" if groups else "cast(array() as array<struct<ord:int,pat_idx:int,variant:string>>)")
    told = live.withColumn("hit", F.explode(found)).select("pkg_id", "file_type", "file", "line_no", "raw", "deobf", "resolved", "hit.*")
    dim = line_table.sparkSession.createDataFrame(known, "ord int, pat_idx int, id string, severity string, pattern string")
    text = F.when(F.col("variant") == "raw", F.col("raw")).when(F.col("variant") == "deobf", F.col("deobf")).otherwise(F.col("resolved"))
    out = told.join(F.broadcast(dim), ["ord", "pat_idx"])  # a row per pattern of the catalog
    return out.select(
        "pkg_id", "id", "severity", "file", F.col("line_no").alias("line"), _byte_column(text, F.col("pattern")).alias("column"), F.trim("raw").alias("snippet"),
        F.when(F.col("variant") != "raw", text).alias("detail"), "ord", "pat_idx", "file_type", "variant",
    )


def structure_matches(bodies: DataFrame, packages: DataFrame, rules: list[catalog.Rule]) -> DataFrame:
    """One row per function or variable that a rule's pattern of that kind is about.

    A function pattern meets functions of recipes (file type pkgbuild) and hooks (install_script) whose name its expression
    finds and in whose executable code its body expression finds something, if it has one; a variable pattern meets the
    variable of exactly that name, on its value. Expressions fold case unless the rule says otherwise. One projection a
    table, no shuffle. Rules that are off, and patterns of other kinds, match nothing here.
    """
    functions, variables = [], []
    for n, r in enumerate(rules):
        fold = "" if r.case_sensitive else "(?i)"
        for i, p in enumerate(r.patterns if r.enabled else ()):
            hit = lambda line, name, n=n, i=i, r=r: F.struct(
                F.lit(r.id).alias("id"), F.lit(r.severity).alias("severity"), F.col("file").alias("file"), line.cast("int").alias("line"), F.lit(None).cast("int").alias("column"), name.cast("string").alias("snippet"),
                F.lit(None).cast("string").alias("detail"), F.lit(n).alias("ord"), F.lit(i).alias("pat_idx"),
            )
            if isinstance(p, catalog.Inert) and p.kind == "function":
                test = F.col("recipe").isin(*["P" in r.files] * ("P" in r.files), *[False] * ("I" in r.files)) & F.col("name").rlike(fold + p.name)
                functions.append(F.when(test & F.col("code").rlike(fold + p.value) if p.value else test, hit(F.col("line_start"), F.col("name"))))
            elif isinstance(p, catalog.Inert) and "P" in r.files:
                value = F.col("variables")[p.name]
                variables.append(F.when(value.rlike(fold + p.value) if p.value else value.isNotNull(), hit(F.lit(None), F.lit(p.name))))
    empty = F.array().cast(f"array<{HIT_TYPE[:-1]},pat_idx:int>>")
    tell = lambda df, hits: df.select("pkg_id", F.explode(F.array_compact(F.array(*hits)) if hits else empty).alias("h")).select("pkg_id", "h.*")
    return tell(bodies, functions).unionByName(tell(packages, variables))


def _own_alternate(names: Column, target: Column) -> Column:
    stem = lambda p: F.regexp_replace(p, rf"(?<=.)-(?:{'|'.join(ALTERNATE)})$", "")
    return F.exists(
        names,
        lambda p: (p == target) | (stem(p) == target) | F.startswith(p, F.concat(target, F.lit("-"))) | F.endswith(p, F.concat(F.lit("-"), target)) | F.startswith(stem(p), F.concat(target, F.lit("-"))),
    )


def displaced(names: Column, *lists: Column) -> Column:
    """Trusted package names in the lists that are not the package's own alternates."""
    wanted = F.array_distinct(F.transform(F.concat(*lists), neturl.dep_name))
    return F.filter(wanted, lambda t: t.isin(*TRUSTED) & ~_own_alternate(names, t))


def _malformed(length: int):
    return lambda x: x.isNotNull() & ((F.length(x) != length) | F.unhex(x).isNull())


def package_hits(packages: DataFrame) -> DataFrame:
    """All checks of a package's own record, as one array per row: source, checksum and metadata codes."""
    c = F.col
    def told(s: Column, i: Column) -> Column:
        # a host is dear, and only those of repositories and forges are asked for
        judged = lambda low, vcs: F.struct(i.alias("i"), s["url"].alias("url"), low.alias("low"), s["protocol"].alias("protocol"), vcs.alias("vcs"), (vcs & neturl.is_pinned(s)).alias("pinned"), F.when(vcs | neturl.may_be_forge(low), neturl.host(s["url"])).alias("host"), F.coalesce(s["fragment"], F.lit("")).alias("fragment"), F.coalesce(s["filename"], F.lit("")).alias("filename"))
        return neturl.once(F.lower(s["url"]), lambda low: neturl.once(neturl.is_vcs(s), lambda vcs: judged(low, vcs)))

    sources = F.transform(c("source"), told)
    df = packages.withColumn("_s", sources)
    sums = [c(f"checksums.{k}") for k in SUM_LENGTHS]
    df = df.withColumns(
        {
            "_plain": F.filter("_s", lambda s: ~s["vcs"]),
            "_displaced": displaced(c("pkgname"), c("replaces"), c("conflicts")),
            "_provided": displaced(c("pkgname"), c("provides")),
            "_most": F.greatest(*map(F.size, sums)),
            "_bad": F.concat(*[F.filter(a, _malformed(n)) for n, a in zip(SUM_LENGTHS.values(), sums, strict=True)]),
            "_host": neturl.host(c("url")),
        }
    )
    # from a column of its own: a host is a long expression, and a forge reads it many times
    df = df.withColumn("_forge", neturl.forge(c("_host")))
    df = df.withColumn("_open", F.size(F.filter("_plain", lambda s: ~F.exists(F.array(*sums), lambda a: F.get(a, s["i"]).isNotNull()))))
    df = df.withColumn("_other", F.when(c("_forge").isNotNull(), F.get(F.filter("_plain", lambda s: s["host"].isNotNull() & F.coalesce(neturl.forge(s["host"]) != c("_forge"), F.lit(False))), F.lit(0))))
    none = F.lit(None).cast("string")
    per_source = lambda test, hit: F.transform(F.filter("_s", test), hit)
    insecure = lambda s: ~s["protocol"].isin(*neturl.SECURE) | F.startswith(s["low"], F.lit("git://")) | F.startswith(s["low"], F.lit("git+http://"))
    listed = lambda code, parts: F.flatten(F.transform("_s", lambda s: F.transform(F.filter(F.array(*map(F.lit, parts)), lambda p: F.contains(s["low"], p)), lambda p: _hit(code, "high", c("file"), snippet=s["url"], detail=p))))
    one = lambda test, hit: F.when(F.coalesce(test, F.lit(False)), F.array(hit)).otherwise(F.array().cast(f"array<{HIT_TYPE}>"))
    has_build = F.exists("functions", lambda f: f["name"] == "build")
    signed = F.exists("_s", lambda s: F.contains(s["fragment"], F.lit("signed")) | F.contains(s["low"], F.lit("?signed")) | F.lower(F.regexp_extract(s["url"], "^[^#?]*", 0)).rlike(r"\.(?:sig|asc|sign)\z") | F.lower(s["filename"]).rlike(r"\.(?:sig|asc|sign)\z"))
    worse = (F.size("_displaced") > 0) | (F.size("_provided") > 0)
    file = c("file")
    hits = [
        per_source(insecure, lambda s: _hit("SRC-001", F.when(s["protocol"].isin("http", "ftp", "git"), "medium").otherwise("low"), file, snippet=s["url"])),
        listed("SRC-002", SUSPICIOUS),
        per_source(lambda s: s["url"].rlike(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), lambda s: _hit("SRC-003", "high", file, snippet=s["url"])),
        listed("SRC-004", SHORTENERS),
        per_source(lambda s: s["vcs"] & ~s["pinned"], lambda s: _hit("SRC-007", "low", file, snippet=s["url"])),
        per_source(lambda s: s["vcs"] & ~neturl.host_in(s["host"], neturl.TRUSTED_VCS_HOSTS), lambda s: _hit("SRC-006", "low", file, snippet=s["url"])),
        one(c("_other").isNotNull(), _hit("SRC-008", "low", file, snippet=c("_other.url"))),
        one((F.size("source") == 0) & (F.size("pkgname") > 0) & has_build, _hit("SRC-005", "medium", file)),
        one((F.size("source") > 0) & (c("_most") == 0), _hit("CHK-001", "high", file)),
        one(F.size("checksums.md5") > 0, _hit("CHK-002", "medium", file)),
        one(F.size("checksums.sha1") > 0, _hit("CHK-003", "medium", file)),
        one((c("_open") > 0) & (c("_open") < F.size("_plain")), _hit("CHK-004", "medium", file, detail=c("_open"))),
        one((c("_open") > 0) & (c("_open") == F.size("_plain")), _hit("CHK-005", "high", file, detail=c("_open"))),
        one((c("_most") > 0) & (c("_most") != F.size("source")), _hit("CHK-006", "high", file, detail=c("_most"))),
        one(F.size("_bad") > 0, _hit("CHK-008", "medium", file, detail=F.array_join("_bad", ", "))),
        one(F.size("_displaced") > 0, _hit("META-003", "high", file, detail=F.array_join("_displaced", ", "))),
        one(F.size("_provided") > 0, _hit("DEP-001", "high", file, detail=F.array_join("_provided", ", "))),
        one(F.expr("try_cast(epoch as bigint)") >= 1, _hit("META-004", F.when(worse, "high").otherwise("low"), file, detail=c("epoch"))),
        one((c("install") != "") & (F.contains("install", F.lit("/")) | F.contains("install", F.lit("..")) | ~F.endswith("install", F.lit(".install"))), _hit("META-005", "medium", file, detail=c("install"))),
        one(F.exists("backup", lambda b: F.exists(F.array(*map(F.lit, SENSITIVE_BACKUP)), lambda p: F.startswith(F.ltrim(b, F.lit("/")), p))), _hit("META-006", "medium", file, detail=F.array_join("backup", ", "))),
        one((F.size("validpgpkeys") > 0) & ~signed, _hit("META-002", "low", file)),
    ]
    return df.select("pkg_id", F.explode(F.concat(*hits)).alias("h")).select("pkg_id", "h.*")


def privilege_hits(bodies: DataFrame) -> DataFrame:
    code, where = F.col("code"), {"file": F.col("file"), "line": F.col("line_start"), "detail": F.col("name")}
    build = F.col("name").isin("build", "package") | F.startswith("name", F.lit("package_"))
    tests = [
        (code.rlike(r"(?i)\bsudo\b") & F.col("recipe"), _hit("PRIV-001", F.when(build, "critical").otherwise("high"), **where)),
        (code.rlike(r"(?i)\bsudo\b") & ~F.col("recipe"), _hit("PRIV-006", "high", **where)),
        (may_match("code", SPECIAL_MODE) & code.rlike(SPECIAL_MODE), _hit("PRIV-002", "critical", **where)),
        (code.rlike(r"(?i)/etc/sudoers") & F.col("recipe"), _hit("PRIV-003", "critical", **where)),
        (code.rlike(r"(?i)setcap\s+"), _hit("PRIV-004", "medium", **where)),
        (code.rlike(r"insmod|modprobe|/lib/modules"), _hit("PRIV-005", "high", **where)),
    ]
    # special modes, capabilities and modules are looked for in recipe functions only
    tests = [(t & F.col("recipe") if n > 1 else t, x) for n, (t, x) in enumerate(tests)]
    hits = F.array_compact(F.array(*[F.when(t, x) for t, x in tests]))
    return bodies.select("pkg_id", F.explode(hits).alias("h")).select("pkg_id", "h.*")


def function_hits(bodies: DataFrame) -> DataFrame:
    """FUNC-001: downloads in build and package functions, unless a comment in the body names the command."""
    low = F.lower(F.col("body"))
    commands = F.filter(F.array(*map(F.lit, ["curl", "wget", "fetch"])), lambda k: (F.contains(low, F.concat(k, F.lit(" "))) | F.contains(low, F.concat(F.lit("$"), k))) & ~F.contains(low, F.concat(F.lit("# "), k)))
    build = F.col("name").isin("build", "package") | F.startswith("name", F.lit("package_"))
    rows = bodies.where(build & F.col("recipe")).select("pkg_id", "file", "line_start", "name", F.explode(commands).alias("k"))
    return rows.select("pkg_id", _hit("FUNC-001", "high", F.col("file"), F.col("line_start"), detail=F.col("k"), snippet=F.col("name")).alias("h")).select("pkg_id", "h.*")


def remote_exec_hits(line_table: DataFrame) -> DataFrame:
    live = line_table.where("not is_comment and not is_info")
    text = F.when(any_part("raw", REMOTE_EXEC_PARTS), F.col("raw")).when(any_part("deobf", REMOTE_EXEC_PARTS), F.col("deobf"))
    urls = F.array_distinct(F.transform(F.regexp_extract_all("_t", F.lit("https?://[^\\s\"'`|)><(]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[;&,.\\}]+$", "")))
    # a generated row, so that a line is searched once and not again for each use of its text
    rows = live.select("pkg_id", "file", "line_no", F.explode(F.array_compact(F.array(text))).alias("_t"))
    return rows.select("pkg_id", _hit("EXEC-REMOTE", "critical", F.col("file"), F.col("line_no"), snippet=F.trim("_t"), detail=F.array_join(urls, " ")).alias("h")).select("pkg_id", "h.*")


def deep_hits(texts: DataFrame) -> DataFrame:
    """Decoding and executing anywhere in a package's code, whichever of its files does either; long encoded blobs.

    Each text is judged where it is, in one pass; flags and the least blob go into the shuffle, texts don't.
    """
    c, recipe_file = F.col, F.col("file_type") == "pkgbuild"
    size = F.length(F.regexp_extract("code", BLOB, 0))
    holds = lambda parts: any_part("code", parts) | ((c("plain") != c("code")) & any_part("plain", parts))
    told = texts.select(
        "pkg_id", F.when(recipe_file, c("file")).alias("recipe"), holds(DECODES_PARTS).alias("decodes"), holds(EXECUTES_PARTS).alias("executes"), F.when(size > 0, F.struct((~recipe_file).alias("hook"), c("file").alias("file"), size.alias("blob"))).alias("blob"),
    )
    one = told.groupBy("pkg_id").agg(F.min("recipe").alias("file"), F.bool_or("decodes").alias("decodes"), F.bool_or("executes").alias("executes"), F.min("blob").alias("blob"))
    both = F.when(c("decodes") & c("executes"), _hit("DEEP-001", "critical", c("file")))
    blob = F.when(c("blob").isNotNull(), _hit("DEEP-002", "high", c("file"), detail=c("blob.blob")))
    return one.select("pkg_id", F.explode(F.array_compact(F.array(both, blob))).alias("h")).select("pkg_id", "h.*")


def findings(ctx: Context, ioc: DataFrame | None = None, min_severity: str = "low", verdicts: DataFrame | None = None, baseline: DataFrame | None = None, structures: bool = False) -> DataFrame:
    """All findings at or above a severity, with the order of a report in analyzer_ord, ord, line and pat_idx.

    With ``structures`` patterns on functions and variables count too; else they match nothing.

    With ``verdicts`` (provider, subject, malicious, suspicious) sources are looked up; with ``baseline``, the state of
    ``provenance``, behaviour that a package gained since is a finding.
    """
    from packsieve.operators import ioc as ioc_op
    from packsieve.operators import provenance, threat

    spark = ctx.files.sparkSession
    parts = [
        ("pattern", rule_matches(ctx.lines, ctx.rules).drop("file_type", "variant")),
        ("pattern", function_hits(ctx.bodies)),
        ("ioc", ioc_op.hits(ctx.texts, ioc if ioc is not None else ioc_op.default_indicators(spark))),
        ("deep", deep_hits(ctx.texts)),
        ("remote_exec", remote_exec_hits(ctx.lines)),
        ("checksum", package_hits(ctx.packages)),
        ("privilege", privilege_hits(ctx.bodies)),
    ]
    if structures:
        parts.append(("pattern", structure_matches(ctx.bodies, ctx.packages, ctx.rules)))
    if verdicts is not None:
        parts.append(("threat_intel", threat.hits(ctx.packages, verdicts)))
    if baseline is not None:
        parts.append(("provenance", provenance.findings(provenance.snapshots(readable(ctx.files), F.lit("")), baseline)))
    order = {a: n for n, a in enumerate(catalog.ANALYZERS)}
    both = None
    for name, df in parts:
        if "pat_idx" not in df.columns:
            df = df.withColumn("pat_idx", F.lit(0))
        df = df.withColumn("analyzer_ord", F.lit(order[name]))
        both = df if both is None else both.unionByName(df)
    known = spark.createDataFrame([tuple(e.values()) for e in catalog.entries()], catalog.CATALOG_TYPE)
    known = known.select("id", "category", F.col("name").alias("title"), "recommendation", F.col("cwe").alias("cwe_id"), "owner")
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    own = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    out = both.join(F.broadcast(known), "id", "left").withColumn("sev_rank", rank[F.col("severity")])  # a row per catalog code
    out = out.withColumn("analyzer_ord", F.when(F.col("owner") == "builtin", 0).otherwise(F.coalesce(own[F.col("owner")], F.col("analyzer_ord"))))
    return out.where(at_least(F.col("sev_rank"), min_severity)).select(*FINDING_COLUMNS)
