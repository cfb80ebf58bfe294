"""What a text must hold for a regular expression to match it, read off the expression itself.

A pattern that needs one of a few literal pieces is only tried on texts that hold one of them. The pieces are derived, not
listed by hand, so the gate can't lose a match.
"""

from __future__ import annotations

import functools
from re import _constants as op
from re import _parser, error

_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)
#: Character classes of more members give no pieces.
MOST_MEMBERS = 8


def _best(found: list[frozenset[str]]) -> frozenset[str] | None:
    """The pieces that let least through: the longest ones, then the fewest."""
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _sequence(items) -> list[frozenset[str]]:
    out, run = [], ""
    for kind, arg in [*items, (None, None)]:
        if kind is op.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            out.append(frozenset([run]))
            run = ""
        if kind is op.SUBPATTERN:
            out += _sequence(arg[3])
        elif kind is op.ATOMIC_GROUP:
            out += _sequence(arg)
        elif kind in _REPEATS and arg[0] > 0:
            out += _sequence(arg[2])
        elif kind is op.BRANCH:
            each = [_best(_sequence(b)) for b in arg[1]]
            if all(each):
                out.append(frozenset().union(*each))
        elif kind is op.IN and len(arg) <= MOST_MEMBERS and all(k is op.LITERAL and v < 128 for k, v in arg):
            out.append(frozenset(chr(v).lower() for _, v in arg))
    return out


@functools.cache
def needles(pattern: str) -> tuple[str, ...]:
    """Lower-case pieces, one of which is in the lower-cased text of every match; empty if none could be derived, as where
    letters beyond ASCII count as equal too."""
    if pattern.startswith("(?iu)"):
        return ()
    try:
        found = _best(_sequence(_parser.parse(pattern)))
    except (error, OverflowError, RecursionError):
        return ()
    return tuple(sorted(found or ()))


@functools.cache
def clauses(pattern: str) -> tuple[tuple[str, ...], ...]:
    """All that could be derived: sets of lower-case pieces, of each of which one is in the lower-cased text of every match; the
    cheapest to look for come first."""
    if pattern.startswith("(?iu)"):
        return ()
    try:
        found = _sequence(_parser.parse(pattern))
    except (error, OverflowError, RecursionError):
        return ()
    return tuple(sorted({tuple(sorted(f)) for f in found}, key=lambda f: (len(f), -min(map(len, f)), f)))
