"""Parser of build recipes and install hooks: text to one record. Nothing is ever run."""

from __future__ import annotations

import json
import re

from packsieve.functions.textnorm import Braces, physical_lines

SCALARS = ("pkgver", "pkgrel", "epoch", "pkgdesc", "url", "install", "changelog")
ARRAYS = ("pkgname", "arch", "license", "depends", "makedepends", "checkdepends", "optdepends", "provides", "conflicts", "replaces", "backup", "options", "validpgpkeys")
SUMS = {"md5sums": "md5", "sha1sums": "sha1", "sha256sums": "sha256", "sha512sums": "sha512", "b2sums": "b2"}
HOOKS = ("pre_install", "post_install", "pre_upgrade", "post_upgrade", "pre_remove", "post_remove")
REQUIRED = ("pkgname", "pkgver", "pkgrel")

_SOURCE = "array<struct<url:string,filename:string,protocol:string,fragment:string>>"
_SUM_TYPE = "struct<" + ",".join(f"{s}:array<string>" for s in SUMS.values()) + ">"
RECIPE_TYPE = ",".join(
    [*(f"{a} array<string>" for a in ARRAYS), *(f"{s} string" for s in SCALARS), f"source {_SOURCE}", f"checksums {_SUM_TYPE}",
     "variables map<string,string>", "functions array<struct<name:string,body:string,line_start:int,line_end:int>>"]
)
HOOK_TYPE = "array<struct<name:string,body:string,line_start:int>>"

_ARRAY = re.compile(r"\s*([A-Za-z_]\w*)(\+?)=\((.*)\Z", re.DOTALL)
_FUNCTION = re.compile(r"\s*(?:function\s+)?([A-Za-z_][\w+.@-]*)\s*\(\)\s*(.*)\Z", re.DOTALL)
_SCALAR = re.compile(r"\s*([A-Za-z_]\w*)=(.*)\Z", re.DOTALL)


class _Scan:
    """Quote state over an array's text."""

    def __init__(self):
        self.quote = ""

    def strip_comment(self, line: str) -> str:
        """The line up to an unquoted # after white space, with the state of its end kept."""
        skip, before = False, " "
        for i, c in enumerate(line):
            if skip:
                skip = False
            elif c == "\\" and self.quote != "'":
                skip = True
            elif self.quote:
                if c == self.quote:
                    self.quote = ""
            elif c in "'\"":
                self.quote = c
            elif c == "#" and before.isspace():
                return line[:i]
            before = c
        return line


def array_end(text: str) -> int:
    """Place of the bracket that closes the array, or -1."""
    quote, skip, depth = "", False, 0
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif c == "\\" and quote != "'":
            skip = True
        elif quote:
            if c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            if not depth:
                return i
            depth -= 1
    return -1


def array_items(text: str) -> list[str]:
    """Elements without their quotes; a backslash takes the next character as it is."""
    out, now, quote, skip = [], [], "", False
    for c in text:
        if skip:
            now.append(c)
            skip = False
        elif c == "\\":
            skip = True
        elif quote:
            if c == quote:
                quote = ""
            else:
                now.append(c)
        elif c in "'\"":
            quote = c
        elif c in " \t\n":
            out.append("".join(now))
            now = []
        else:
            now.append(c)
    out.append("".join(now))
    return [x for x in map(str.strip, out) if x]


_PROTOCOLS = ("git", "svn", "hg", "bzr", "https", "http", "ftps", "ftp", "file")


def protocol(url: str) -> str:
    low = url.lower()
    for p in ("git", "svn", "hg", "bzr"):
        if low.startswith((f"{p}+", f"{p}://")):
            return p
    for p in ("https", "http", "ftps", "ftp", "file"):
        if low.startswith(f"{p}://"):
            return p
    return low.split("://", 1)[0] if "://" in low else "file"


def source_entry(item: str) -> dict:
    name, sep, url = item.partition("::")
    if not sep:
        name, url = None, item
    parts = url.split("#")
    return {"url": url, "filename": name, "protocol": protocol(url), "fragment": parts[1] if len(parts) > 1 else None}


def _unquote(value: str) -> str:
    value = _Scan().strip_comment(value).strip()
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
        return value[1:-1]
    return value


def parse_recipe(text: str) -> dict | None:
    """The record of a recipe; None for one without text."""
    if not text or not text.strip():
        return None
    out: dict = {a: [] for a in ARRAYS} | dict.fromkeys(SCALARS) | {"source": [], "checksums": {s: [] for s in SUMS.values()}, "variables": {}, "functions": []}
    functions: dict[str, dict] = {}

    def assign(name: str, more: bool, items: list[str]) -> None:
        if name == "source" or name.startswith("source_"):
            found = list(map(source_entry, items))
            out["source"] = out["source"] + found if more or name != "source" else found
        elif name in SUMS or re.sub(r"_\w+\Z", "", name) in SUMS:
            key = SUMS[name if name in SUMS else re.sub(r"_\w+\Z", "", name)]
            sums = [None if x in ("SKIP", "") else x for x in items]
            out["checksums"][key] = out["checksums"][key] + sums if more or name not in SUMS else sums
        elif name in ARRAYS:
            out[name] = out[name] + items if more else items
        elif name in SCALARS:
            out[name] = items[0] if items else None
        else:
            out["variables"][name] = json.dumps(items)

    open_name, open_more, buffer, scan = "", False, "", _Scan()
    braces, body, function = None, [], None
    lines = physical_lines(text)
    for n, line in enumerate(lines, 1):
        if function is not None:
            body.append(line)
            braces.feed(line)
            if braces.peak and braces.depth <= 0:
                functions[function[0]] = {"name": function[0], "body": "\n".join(body), "line_start": function[1], "line_end": n}
                function = None
            continue
        if open_name:
            buffer += "\n" + scan.strip_comment(line)
            end = array_end(buffer)
            if end >= 0:
                assign(open_name, open_more, array_items(buffer[:end]))
                open_name = ""
            continue
        if line.lstrip().startswith("#") or not line.strip():
            continue
        m = _ARRAY.match(line) if "=(" in line else None
        if m:
            scan = _Scan()
            content = scan.strip_comment(m[3])
            end = array_end(content)
            if end >= 0:
                assign(m[1], bool(m[2]), array_items(content[:end]))
            else:
                open_name, open_more, buffer = m[1], bool(m[2]), content
            continue
        m = _FUNCTION.match(line) if "()" in line else None
        if m:
            braces, body, function = Braces(), [line], (m[1], n)
            braces.feed(line)
            if braces.peak and braces.depth <= 0:
                functions[m[1]] = {"name": m[1], "body": line, "line_start": n, "line_end": n}
                function = None
            continue
        m = _SCALAR.match(line) if "=" in line else None
        if m:
            name, value = m[1], _unquote(m[2])
            if name == "pkgname":
                out["pkgname"] = [value]
            elif name in SCALARS:
                out[name] = value
            else:
                out["variables"][name] = value
    if open_name:
        assign(open_name, open_more, array_items(buffer))
    out["functions"] = sorted(functions.values(), key=lambda f: (f["line_start"], f["name"]))
    return out


def missing_fields(record: dict) -> list[str]:
    """What strict parsing asks for and the record lacks."""
    return [f for f in REQUIRED if not record[f]]


_HOOK = re.compile(rf"^[ \t]*({'|'.join(HOOKS)})[ \t]?\(\)", re.MULTILINE)


def parse_hooks(text: str) -> list[dict]:
    """Hook functions of an install file; one without a closing brace is dropped."""
    out = []
    text = (text or "").replace("\r\n", "\n")
    for m in _HOOK.finditer(text):
        start = text.find("{", m.end())
        if start < 0:
            continue
        braces, at = Braces(), start
        for line in text[start:].split("\n"):
            braces.feed(line)
            at += len(line) + 1
            if braces.depth <= 0:
                break
        else:
            continue
        body = text[start : at - 1]
        out.append({"name": m[1], "body": body[: body.rfind("}") + 1], "line_start": text.count("\n", 0, m.start()) + 1})
    return out


def install_name(record: dict) -> str | None:
    """The hook file a recipe declares, with the spellings of its name expanded; None if none or unsafe."""
    value = record.get("install")
    if not value:
        return None
    name = (record["pkgname"] or [""])[0]
    for k, v in (("pkgname", name), ("pkgver", record.get("pkgver") or "")):
        value = value.replace("${%s}" % k, v).replace("$" + k, v)
    value = value.strip().strip("'\"")
    return None if not value or "/" in value or ".." in value else value
