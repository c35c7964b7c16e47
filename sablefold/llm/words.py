"""Vectorised word and shingle hashing over the UTF-8 bytes of Arrow batches.

Words are maximal runs of bytes other than x20 and x09-x0D; A-Z count as a-z.
Since the separators are ASCII, byte runs equal code-point runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLAB = 1 << 21  # bytes hashed at a time; a longer text is a slab of its own
_ROOT = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = h ^ U((salt * _ROOT) & (2**64 - 1))
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        return h ^ (h >> U(32))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
BYTE_CODE = mix(np.arange(1, 257, dtype=U), 7)[LOWER]
_powers = {"n": 0, "up": np.empty(0, U), "down": np.empty(0, U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        n = max(n, SLAB + 1)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                a = np.full(n, U(base))
                a[0] = 1
                _powers[key] = np.multiply.accumulate(a)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


@dataclass
class Slab:
    """Texts ``lo:hi`` of a batch: their bytes and the offsets of each in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def slabs(column: pa.Array) -> Iterator[Slab]:
    """Null texts are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLAB, "right")) - 1)
        hi = min(hi, n)
        yield Slab(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def word_spans(slab: Slab, outside: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the slab and the number of words in each text; ``outside`` marks the bytes between words."""
    inside = ~outside[slab.data]
    first = np.empty(len(inside), bool)
    if len(inside):
        first[0] = True
        np.logical_not(inside[:-1], out=first[1:])
        cuts = slab.offsets[:-1]
        first[cuts[cuts < len(inside)]] = True
        last = np.empty(len(inside), bool)
        last[-1] = True
        np.logical_not(inside[1:], out=last[:-1])
        ends_at = slab.offsets[1:] - 1
        last[ends_at[ends_at >= 0]] = True
        starts = np.flatnonzero(first & inside)
        ends = np.flatnonzero(last & inside) + 1
    else:
        starts = ends = np.empty(0, np.int64)
    edges = np.searchsorted(starts, slab.offsets)
    return starts, ends, np.diff(edges)


def word_hashes(slab: Slab, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODE) -> np.ndarray:
    """A 64-bit hash of every word, from prefix sums of a polynomial over its bytes' codes."""
    up, down = _power(len(slab.data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(slab.data) + 1, U)
        sums[0] = 0
        np.cumsum(codes[slab.data] * up[: len(slab.data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def shingles(h: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words, text by text, and their number in each text.

    A text of fewer words gives its whole sequence as one; one without words gives none.
    """
    n = len(h)
    out_counts = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    with np.errstate(over="ignore"):
        total = np.zeros(n, U)
        last = np.cumsum(counts)
        left = np.repeat(last, counts) - np.arange(n)  # words from this one to the end of its text
        for j in range(width):
            m = n - j
            if m > 0:
                part = h[j:] * U((_BASE ** (j + 1)) & (2**64 - 1))
                total[:m] += np.where(left[:m] > j, part, U(0)) if j else part
        total = mix(total + np.minimum(left, width).astype(U))
    first = np.zeros(n, bool)
    begin = last - counts
    first[begin[counts > 0]] = True
    return total[(left >= width) | first], out_counts


def sorted_sets(sh: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles sorted without repeats, and the size of each set."""
    sh = sh.copy()
    edges = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            sh[a:b].sort()
    keep = np.ones(len(sh), bool)
    if len(sh):
        keep[1:] = sh[1:] != sh[:-1]
        begins = edges[:-1]
        keep[begins[begins < len(sh)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return sh[keep], np.diff(kept[edges])


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Wrapping uint64 sums of consecutive runs of ``counts`` values."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    edges = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        return total[edges[1:]] - total[edges[:-1]]
