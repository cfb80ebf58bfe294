"""Array kernels over UTF-8 bytes: words, shingle sets and window hashes for many texts at once.

Hashes are polynomials modulo 2**64 over a random table of bytes, then mixed. Texts are handled in runs of about
``RUN_BYTES``; a longer text is a run of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 19
SPACES = b" \t\n\x0b\x0c\r"
_rng = np.random.default_rng(20240607)
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = TABLE.copy()
LOWER[65:91] = TABLE[97:123]
TABLE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 2 * RUN_BYTES)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        known = (out[0], out[1])
        if n <= 4 * RUN_BYTES:
            _powers[base] = known
    return known


def prefix_sums(data: np.ndarray, table: np.ndarray = TABLE, base: int = BASES[0]) -> np.ndarray:
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(base, len(data) + 1)[0][: len(data)], out=s[1:])
    return s


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hash of data[start:end], for arrays of starts and ends."""
    h = sums[end] - sums[start]
    h *= powers(base, len(sums))[1][start]
    return mix(h)


def runs(texts: pa.Array):
    """(first text, byte array, offsets) of consecutive texts; nulls are empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and how many words each text has. Words don't cross texts; ``gaps`` tells the bytes between them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    gap = gaps[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = gap[:-1]
    bounds = offsets[:-1]
    first[bounds[bounds < len(data)]] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = gap[1:]
    ends = offsets[1:]
    last[ends[ends > 0] - 1] = True
    starts = np.flatnonzero(first & ~gap)
    stops = np.flatnonzero(last & ~gap) + 1
    return starts, stops, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(texts: pa.Array, width: int):
    """For each text its sorted distinct ``width``-word shingle hashes; A-Z count as a-z. With fewer words the whole
    sequence is one shingle; without words the set is empty."""
    for _, data, offsets in runs(texts):
        starts, stops, counts = word_spans(data, offsets)
        words = span_hash(prefix_sums(data, LOWER), starts, stops)
        step = np.uint64(0xBF58476D1CE4E5B9)
        if len(words) >= width:
            h = words[: len(words) - width + 1].copy()
            for k in range(1, width):
                h *= step
                h += words[k : len(words) - width + 1 + k]
                mix(h)
        else:
            h = np.zeros(0, np.uint64)
        at = 0
        for n in counts.tolist():
            if n >= width:
                yield np.unique(h[at : at + n - width + 1])
            elif n:
                x = np.array([n], np.uint64)
                for w in words[at : at + n]:
                    x *= step
                    x += w
                    mix(x)
                yield x
            else:
                yield np.zeros(0, np.uint64)
            at += n
