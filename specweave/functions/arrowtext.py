"""Arrow string columns as flat numpy code-point arrays, and back.

The text kernels of the engine work on one array of code points for a whole batch with an offset
per row, so no Python string is made per row. Null rows are empty here; callers keep the validity.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; bounds a kernel's memory whatever the length of the texts.
SLICE_BYTES = 4 << 20
MAX_CP = sys.maxunicode + 1
# Blocks of characters of one kind, from the Unicode block list.
ALIKE = [(0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xD800, 0xE000), (0xE000, 0xF900), (0x323B0, 0xE0000), (0xE01F0, 0xF0000), (0xF0000, 0x10FFFE)]


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets, starting at 0. Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type not in (pa.string(), pa.large_string()):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if col.type == pa.large_string() else np.int32
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def codepoints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of a string column and its n+1 offsets in code points."""
    raw, offs = byte_view(col)
    if raw.size == 0:
        return np.empty(0, np.uint32), np.zeros(len(offs), np.int64)
    if raw.max() < 0x80:
        return raw.astype(np.uint32), offs
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.zeros(raw.size + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    return cps, starts[offs]


def to_strings(cps: np.ndarray, offs: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of :func:`codepoints`; ``valid`` marks the rows that are not null."""
    n = len(offs) - 1
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    if len(data) == cps.size:
        at = offs
    else:
        width = np.zeros(cps.size + 1, np.int64)
        np.cumsum(1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF), out=width[1:])
        at = width[offs]
    mask = None
    if valid is not None and not valid.all():
        mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), n, [mask, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data)])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch with about ``limit`` bytes of ``column`` each, one row at least."""
    _, offs = byte_view(batch.column(column))
    n, start = len(offs) - 1, 0
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


@cache
def char_table(rule: Callable[[str], int], kind: type = np.uint8) -> np.ndarray:
    """``rule`` of every code point, as a lookup table (surrogates give 0).

    Blocks whose characters are all alike (ideographs, Hangul syllables, private use, the empty
    planes) are filled with the rule of one of them, so a worker has its table in no time."""
    t = np.zeros(MAX_CP, kind)
    for lo, hi in ALIKE:
        if lo != 0xD800:
            same = rule(chr(lo + 1))
            t[lo:hi] = np.arange(lo, hi) if same == lo + 1 else same
    for lo, hi in zip([0, *(b for _, b in ALIKE)], [*(a for a, _ in ALIKE), MAX_CP], strict=True):
        for c in range(lo, hi):
            if v := rule(chr(c)):
                t[c] = v
    return t


def _alnum(ch: str) -> int:
    return ch.isalnum()


def _fold(ch: str) -> int:
    low = ch.casefold()
    return ord(low) if len(low) == 1 else ord(ch)


def _spread(ch: str) -> int:
    return len(ch.casefold()) if len(ch.casefold()) > 1 else 0


def alnum_table() -> np.ndarray:
    """1 for letters and digits."""
    return char_table(_alnum)


def fold_table() -> np.ndarray:
    """The code point without its letter case (itself where that takes several, see :func:`spread_case`)."""
    return char_table(_fold, np.uint32)


def spread_case(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points whose folding takes several (sharp s, ligatures, some accented capitals) replaced by
    these, and where each code point has gone: n+1 offsets, None where nothing moved. All other code
    points stay as they are; :func:`fold_table` folds them."""
    count = char_table(_spread)[cps] if cps.size and cps.max() > 0x7F else np.empty(0, np.uint8)
    if not count.any():
        return cps, None
    at = np.flatnonzero(count)
    n = np.maximum(count, 1)
    offs = np.zeros(cps.size + 1, np.int64)
    np.cumsum(n, out=offs[1:])
    out = np.repeat(cps, n)
    kinds, which = np.unique(cps[at], return_inverse=True)
    flat = np.zeros((kinds.size, int(n.max())), np.uint32)
    for i, c in enumerate(kinds):
        low = [ord(x) for x in chr(c).casefold()]
        flat[i, : len(low)] = low
    for k in range(int(n.max())):
        some = n[at] > k
        out[offs[at[some]] + k] = flat[which[some], k]
    return out, offs


def word_runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked characters; a text's end is a border even between two."""
    mark = np.zeros(inside.size + 2, bool)
    mark[1:-1] = inside
    first, last = mark[1:-1] & ~mark[:-2], mark[1:-1] & ~mark[2:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < inside.size)]
    glued = inner[mark[inner + 1] & mark[inner]]
    first[glued] = True
    last[glued - 1] = True
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants); wraps around."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; ``n`` is rounded up by the callers to few sizes."""
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def run_hashes(sym: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of the runs sym[starts:ends] (symbols mixed before)."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    longest = int((ends - starts).max())
    p = powers(base, 1 << max(6, (max(longest, 1) - 1).bit_length()))
    lens = ends - starts
    total = int(lens.sum())
    firsts = np.zeros(len(starts), np.int64)
    np.cumsum(lens[:-1], out=firsts[1:])
    inside = np.arange(total, dtype=np.int64) - np.repeat(firsts, lens)
    vals = sym[inside + np.repeat(starts, lens)] * p[inside]
    out = np.zeros(len(starts), np.uint64)
    some = lens > 0
    if some.any():
        out[some] = np.add.reduceat(vals, firsts[some])
    return mix64(out + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
