"""Column expressions over URLs, hosts, sources and package names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VCS = ["git", "svn", "hg", "bzr"]
SECURE = ["https", "ftps", "git", "file"]
#: Spellings that hide a host, in the order they are undone.
DEFANGED = [
    ("hxxps", "https"), ("hxxp", "http"), ("[://]", "://"), ("[:]", ":"), ("[.]", "."), ("(.)", "."), ("{.}", "."),
    ("[dot]", "."), ("(dot)", "."), ("{dot}", "."), ("[DOT]", "."), ("(DOT)", "."),
]
#: Forges by host suffix.
FORGES = {
    "github.com": "github", "githubusercontent.com": "github", "github.io": "github", "gitlab.com": "gitlab", "gitlab.io": "gitlab",
    "codeberg.org": "codeberg", "bitbucket.org": "bitbucket", "sr.ht": "sourcehut", "gitea.com": "gitea", "sourceforge.net": "sourceforge",
}
#: Hosts whose repositories are usual.
TRUSTED_VCS_HOSTS = [
    "github.com", "gitlab.com", "codeberg.org", "bitbucket.org", "sr.ht", "git.sr.ht", "git.kernel.org", "gitlab.freedesktop.org",
    "gitlab.gnome.org", "invent.kde.org", "salsa.debian.org", "git.savannah.gnu.org",
]


def refang(text: Column) -> Column:
    for old, new in DEFANGED:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


#: The host of an undisguised URL: after a scheme, or at the start where no scheme follows; behind user names, without brackets,
#: the root's dot and a port. White space or a backslash before the path is no host.
_AUTHORITY = (
    r"^(?i:(?:git|svn|hg|bzr)\+)?(?:[A-Za-z][A-Za-z0-9+.-]*://|(?![^#]*://))(?![^/?#]*[\s\\])"
    r"(?:[^/?#]*@)?\[?([^/?#@]*?)\]?\.?(?::\d*)?(?=[/?#]|$)"
)


def host(url: Column) -> Column:
    """The host of a URL, lower-case; null if there is none or the authority holds a backslash. One expression over the
    URL, as it is used where an engine evaluates each mention anew."""
    return F.nullif(F.lower(F.regexp_extract(refang(url), _AUTHORITY, 1)), F.lit(""))


_LABEL = r"[a-z0-9]++(?:-++[a-z0-9]++)*+"
#: A host of two labels or more from where a word begins, with its port and all of its path, which is no host. Its loops
#: give nothing back, so a line is read once.
_HOST = rf"(?i)(?<![a-z0-9-])-*+({_LABEL}(?:\.{_LABEL})++)(?!://)(?::\d++)?+(?:[/?#][^\s'\"]*+)?+"
_USERINFO = r"(?<![^\s/@'\"])[^\s/@'\"]++@"


def hosts_in(text: Column) -> Column:
    """The distinct hosts that a text names, lower-case, in order: disguised spellings are undone, what stands before an ``@``
    and paths are no hosts. A null text names none."""
    told = F.regexp_replace(refang(F.coalesce(text, F.lit(""))), _USERINFO, "")
    return F.array_distinct(F.transform(F.regexp_extract_all(told, F.lit(_HOST), F.lit(1)), F.lower))


def host_name(text: Column) -> Column:
    """A host or domain as it is compared: undisguised, lower-case, without brackets and the root's dot."""
    return F.lower(F.regexp_replace(refang(F.trim(text)), r"^[\[\]]+|[\[\]]+$|\.+$", ""))


def above(host: Column) -> Column:
    """A host and all that it is below, at label boundaries: ``a.b.c`` gives ``a.b.c``, ``b.c`` and ``c``."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def host_in(name: Column, suffixes: list[str]) -> Column:
    """Whether a host is one of the names or below one; null hosts are not."""
    out = F.lit(False)
    for s in suffixes:
        out = out | (name == s) | F.endswith(name, F.lit("." + s))
    return F.coalesce(out, F.lit(False))


def may_be_forge(low: Column) -> Column:
    """A cheap condition that the lower-case URL of every forge meets: undoing a disguise puts no letters together."""
    out = F.lit(False)
    for part in sorted({suffix.split(".")[0] for suffix in FORGES}):
        out = out | F.contains(low, F.lit(part))
    return out


def forge(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for suffix, key in reversed(list(FORGES.items())):
        out = F.when((name == suffix) | F.endswith(name, F.lit("." + suffix)), key).otherwise(out)
    return out


def once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` mentions it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def protocol(url: Column) -> Column:
    def told(low: Column) -> Column:
        out = F.when(F.instr(low, "://") > 0, F.substring_index(low, "://", 1)).otherwise("file")
        for p in reversed(VCS):
            out = F.when(F.startswith(low, F.lit(p + "+")), p).otherwise(out)
        return out

    return once(F.lower(url), told)


def source(item: Column) -> Column:
    """A source entry as a struct: url, filename before ``::`` if there is one, protocol, and what stands between the first
    two ``#``."""

    def told(x: Column) -> Column:
        named = F.instr(x, "::") > 0
        url = F.when(named, F.substring(x, F.instr(x, "::") + 2, F.length(x))).otherwise(x)
        fragment = lambda u: F.when(F.contains(u, F.lit("#")), F.get(F.split(u, "#"), F.lit(1)))
        return once(url, lambda u: F.struct(u.alias("url"), F.when(named, F.substring_index(x, "::", 1)).alias("filename"), protocol(u).alias("protocol"), fragment(u).alias("fragment")))

    return once(item, told)


def is_vcs(source: Column) -> Column:
    low = F.lower(source["url"])
    return source["protocol"].isin(*VCS) | F.contains(low, F.lit("git+http")) | F.endswith(low, F.lit(".git"))


def is_pinned(source: Column) -> Column:
    """Whether a repository's fragment names a revision that can't move."""
    parts = F.split(F.lower(source["fragment"]), "[&? ]")
    return is_vcs(source) & F.coalesce(F.exists(parts, lambda p: F.startswith(p, F.lit("commit=")) | F.startswith(p, F.lit("revision="))), F.lit(False))


def dep_name(spec: Column) -> Column:
    """A dependency's bare name: before a description or version."""
    return F.trim(F.regexp_extract(F.regexp_replace(F.trim(spec), "^['\"]+|['\"]+$", ""), "^[^:<>=]*", 0))


def valid_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9@_+][A-Za-z0-9@._+-]{0,255}\z")
