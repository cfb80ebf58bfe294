"""Per-text state machines of shell text: logical lines, de-quoting, variable resolution, informational lines.

Each works on one file, in one pass whose time and memory grow as the file does, so a file never leaves its task.
"""

from __future__ import annotations

import re

#: What a reader of package trees takes; rows of a table are scanned at any size.
MAX_FILE_BYTES = 2 << 20
MAX_VALUE_BYTES = 512
#: Words that print, and commands whose here-documents are printed text.
PRINTERS = frozenset(["echo", "printf", "print", "note", "msg", "msg2", "warning", "plain", "error"])
HEREDOC_PRINTERS = frozenset(["cat", "echo", "printf"])
#: Names that the build sets; names in capitals count too.
BUILD_VARIABLES = frozenset(["pkgname", "pkgbase", "pkgver", "pkgrel", "epoch", "pkgdir", "srcdir", "startdir", "builddir"])


def physical_lines(text: str) -> list[str]:
    lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    return lines[:-1] if lines and lines[-1] == "" else lines


def logical_lines(text: str) -> list[tuple[int, str]]:
    """(first line number from 1, text), lines joined where the first ends in an odd number of backslashes."""
    if "\\" not in text:
        return list(enumerate(physical_lines(text), 1))
    out, start, parts = [], 0, ""
    for n, line in enumerate(physical_lines(text), 1):
        if not parts:
            start = n
        slashes = len(line) - len(line.rstrip("\\"))
        if slashes % 2:
            parts += line[:-1]
            continue
        out.append((start, parts + line))
        parts = ""
    if parts:
        out.append((start, parts))
    return out


#: Characters that an escape stands for; any other stands for itself, as an x without digits does.
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "e": "\x1b", "E": "\x1b", "f": "\f", "v": "\v"}
_PRINTF_CONTROL = {"n": "\n", "t": "\t", "r": "\r"}
_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{1,2})|([0-7]{1,3})|(.))", re.DOTALL)


def unescape(body: str, control: dict[str, str] = _CONTROL) -> str:
    """The text of an ANSI-C quoted body, or of a format with the escapes of ``control``."""

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        if m[2]:
            return chr(int(m[2], 8))
        return control.get(m[3], m[3])

    return _ESCAPE.sub(one, body)


_QUOTED = re.compile(r"""\$'((?:[^'\\]|\\.|\\\Z)*)(?:'|\Z)|'([^']*)(?:'|\Z)|"((?:[^"\\]|\\.|\\\Z)*)(?:"|\Z)|\\(.)""", re.DOTALL)
_IN_DOUBLE = re.compile(r'\\([$`"\\])')


def deobfuscate(line: str) -> str:
    """The line as the shell reads it once quotes are taken off. One that isn't closed on its line ends with it."""
    if not ("'" in line or '"' in line or "\\" in line):
        return line

    def one(m: re.Match) -> str:
        if m[1] is not None:
            return unescape(m[1])
        if m[2] is not None:
            return m[2]
        if m[3] is not None:
            return _IN_DOUBLE.sub(r"\1", m[3])
        return m[4]

    return _QUOTED.sub(one, line)


def deobfuscate_text(text: str) -> str:
    if not ("'" in text or '"' in text or "\\" in text or "\r" in text or text.endswith("\n")):
        return text
    return "\n".join(map(deobfuscate, physical_lines(text)))


_FUNCTION = re.compile(r"\s*(?:(?:function\s+)?[A-Za-z_][\w:-]*\s*\(\s*\)|function\s+[A-Za-z_][\w:-]*)")
_DECLARED = re.compile(r"\s*(?:(?:local|export|readonly|declare|typeset)\s+(?:-\S*\s*)*)*")
_ASSIGN = re.compile(r"([A-Za-z_]\w*)=(.*)\Z", re.DOTALL)
_USE = re.compile(r"\$\{!([A-Za-z_]\w*)\}|\$\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)")
_FORMAT = r"""\s*printf\s+(?:'([^']*)'|"([^"]*)"|(\S+))\s*"""
_PRINTF = re.compile(rf"\$\({_FORMAT}\)|`{_FORMAT}`")


def _tracked(name: str) -> bool:
    return name not in BUILD_VARIABLES and not name.isupper()


def _substituted(text: str, known: dict[str, str]) -> str:
    if not known or "$" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[1]:
            return known.get(known.get(m[1], ""), m[0])
        return known.get(m[2] or m[3], m[0])

    return _USE.sub(one, text)


def constant(text: str, known: dict[str, str]) -> str | None:
    """The value that an assignment's right side has whatever runs: quoted and known parts, or one ``printf`` of a constant
    format in either kind of substitution. Nothing is run; a part that isn't known makes it None."""
    text = text.strip()
    told = _PRINTF.fullmatch(text)
    if told:
        value = unescape(next((g for g in told.groups() if g is not None), ""), _PRINTF_CONTROL)
    elif "$(" in text or "`" in text:
        return None
    else:
        value = deobfuscate(_substituted(text, known))
        if "$" in value:
            return None
    return value if len(value.encode()) <= MAX_VALUE_BYTES else None


def resolve_lines(lines: list[str]) -> list[str]:
    """Lines with variables of constant value replaced, in order; a function header forgets all values."""
    out, known = [], {}
    for line in lines:
        if line.lstrip().startswith("#"):
            out.append(line)
            continue
        if ("(" in line or "function" in line) and _FUNCTION.match(line):
            known = {}
        out.append(_substituted(line, known))
        if "=" not in line:
            continue
        m = _ASSIGN.match(line, _DECLARED.match(line).end())
        if m and _tracked(m[1]):
            value = constant(m[2], known)
            if value is None:
                known.pop(m[1], None)
            else:
                known[m[1]] = value
    return out


def has_operator(line: str) -> bool:
    """Whether the line does more than print: an unquoted ; | & >, or a substitution outside single quotes."""
    quote, skip = "", False
    for i, c in enumerate(line):
        if skip:
            skip = False
        elif c == "\\" and quote != "'":
            skip = True
        elif quote == "'":
            if c == "'":
                quote = ""
        elif c == "`" or (c == "$" and line[i + 1 : i + 2] == "("):
            return True
        elif quote == '"':
            if c == '"':
                quote = ""
        elif c in "'\"":
            quote = c
        elif c in ";|&>":
            return True
    return False


def is_print(line: str) -> bool:
    words = line.split(None, 1)
    return bool(words) and words[0] in PRINTERS and not has_operator(line)


_HEREDOC = re.compile(r"<<(-?)\s*(?:'([^']+)'|\"([^\"]+)\"|\\?([A-Za-z_]\w*))")


def printed_heredoc(line: str) -> str | None:
    """The delimiter of a here-document that is only printed; one that is redirected, piped or run is not."""
    m = _HEREDOC.search(line) if "<<" in line else None
    if not m or line[m.end() : m.end() + 1] == "<" or (m.start() and line[m.start() - 1] == "<"):
        return None
    if line[: m.start()].rstrip()[-1:].isdigit() and "((" in line:
        return None
    rest = line[: m.start()] + line[m.end() :]
    if ">" in rest or "|" in rest or "tee " in rest:
        return None
    last = re.split(r"[;&|(]", line[: m.start()])[-1].split()
    if not last or last[0] not in HEREDOC_PRINTERS:
        return None
    return m[2] or m[3] or m[4]


def informational(lines: list[str]) -> list[bool]:
    """Flags of lines that only print: pure printer lines, and printed here-documents with their end."""
    out, end = [], None
    for line in lines:
        if end is not None:
            out.append(True)
            if line.strip() == end:
                end = None
            continue
        end = printed_heredoc(line)
        out.append(end is not None or is_print(line))
    return out


def is_comment(line: str) -> bool:
    return line.lstrip().startswith("#")


Flagged = tuple[list[tuple[int, str]], list[bool]]


def flagged(text: str) -> Flagged:
    """The logical lines of a text and their flags: what the three functions below take if it is at hand."""
    numbered = logical_lines(text)
    return numbered, informational([t for _, t in numbered])


def executable_body(text: str, told: Flagged | None = None) -> str:
    """Logical lines without comments and informational lines."""
    numbered, flags = told or flagged(text)
    return "\n".join(t for (_, t), info in zip(numbered, flags, strict=True) if not info and not is_comment(t))


def masked(text: str, told: Flagged | None = None) -> str:
    """Physical lines with informational ones blanked, so numbers stay."""
    lines = physical_lines(text)
    # without a backslash the logical lines are the physical ones
    flags = told[1] if told and "\\" not in text else informational(lines)
    return "\n".join("" if info else t for t, info in zip(lines, flags, strict=True))


def variants(text: str, told: Flagged | None = None) -> list[dict]:
    """The line table of one file: number, raw, de-quoted and resolved text where they differ, flags."""
    numbered, flags = told or flagged(text)
    raw = [t for _, t in numbered]
    plain = [deobfuscate(t) for t in raw]
    resolved = resolve_lines(raw)
    out = []
    for (n, t), info, d, r in zip(numbered, flags, plain, resolved, strict=True):
        r = deobfuscate(r) if r != t else None
        out.append({"line_no": n, "raw": t, "deobf": d if d != t else None, "resolved": r if r not in (t, d, None) else None, "is_comment": is_comment(t), "is_info": info})
    return out


class Braces:
    """Depth of curly braces over lines, blind to quotes, escapes and comments."""

    def __init__(self):
        self.depth = self.peak = 0
        self.quote = ""

    def feed(self, line: str) -> None:
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
                break
            elif c == "{":
                self.depth += 1
                self.peak = max(self.peak, self.depth)
            elif c == "}":
                self.depth -= 1
                if self.peak and self.depth <= 0:
                    return
            before = c
