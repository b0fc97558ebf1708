"""Problem 3: records that differ only in formatting, each once with its number of copies.

The payload's code points stream through a lookup table that folds letter case and skips white space
and punctuation; what is kept goes into rolling polynomial hashes, one of each field name and value,
whose mixed sum over the fields is the record's hash, so field order drops out. No folded record is
laid out. Rows of equal hash are verified by two pointers that run over the two payloads as they are,
skip what the table skips and fold what they meet; all pairs of a batch advance together, a bounded
number of symbols a step.

Copies are first collapsed within an Arrow batch, so a group that holds a third of all rows sends
one row a batch through the one shuffle, and the payload travels only with such representatives.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.functions.arrowtext import char_table, codepoints, fold_table, mix64, run_hashes, slices, spread_case
from specweave.session import scan_width, schema_plus

_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93)
_QUOTE, _BACK, _COMMA, _COLON, _OPEN, _CLOSE, _BRACKET = 34, 92, 44, 58, 123, 125, 91
_DROP, _LETTER, _DIGIT, _MINUS, _POINT, _PLUS = 1, 2, 3, 4, 5, 6
#: Symbols that the two pointers of a pair advance over in a step.
STEP = 64


def _kind(ch: str) -> int:
    """How the table treats a character; 0: any other symbol, kept as it is."""
    if ch in "-−":
        return _MINUS
    if ch == ".":
        return _POINT
    if ch == "+":
        return _PLUS
    cat = unicodedata.category(ch)
    if cat[0] in "PZC":
        return _DROP
    return _LETTER if cat[0] in "LM" else _DIGIT if cat == "Nd" else 0


def kinds() -> np.ndarray:
    return char_table(_kind)


class Folded:
    """A slice of flat JSON objects as they are written, with what the table keeps of them.

    ``cps`` are the code points, ``kept`` the places of those that count, ``runs`` two runs in
    ``kept`` for each field (name, value), ordered by row and field hash; ``row`` is the row of each
    field, ``h`` its two hashes, ``sign`` marks the signs of numbers.
    """

    def __init__(self, col: pa.Array):
        col = _flat_only(col)
        cps, offs = codepoints(col)
        self.rows = len(offs) - 1
        cps, offs, literal = _unescape(cps, offs)
        wide, moved = spread_case(cps)
        if moved is not None:
            literal = np.repeat(literal, np.diff(moved))
            cps, offs = wide, moved[offs]
        if cps.size == 0:
            self._empty()
            return
        quote = (cps == _QUOTE) & ~literal
        inside = (np.cumsum(quote) & 1).astype(bool) | quote
        delim = ~inside & ((cps == _COMMA) | (cps == _COLON) | (cps == _OPEN) | (cps == _CLOSE))
        seg = np.cumsum(delim)
        kind = kinds()[cps]
        keep, self.sign = _counting(cps, kind, seg)
        keep &= ~quote & ~delim
        # Segments between delimiters: names before a colon, values after it.
        at = np.flatnonzero(delim)
        colon = cps[at] == _COLON
        value_seg = np.flatnonzero(colon) + 1
        kept = np.flatnonzero(keep)
        kseg = seg[kept]
        lo = np.searchsorted(kseg, value_seg)
        hi = np.searchsorted(kseg, value_seg, "right")
        name_lo, name_hi = np.searchsorted(kseg, value_seg - 1), lo
        # A bare null is as absent as an empty value.
        bare = np.ones(value_seg.size, bool)
        quoted = np.unique(seg[np.flatnonzero(quote)])
        bare[np.isin(value_seg, quoted)] = False
        full = hi > lo
        self.cps, self.kept = cps, kept
        if kept.size:
            first = np.minimum(lo, kept.size - 1)
            full &= ~(bare & (cps[kept[first]] == 110))
        row = np.searchsorted(offs, at[value_seg - 1], "right") - 1
        lo, hi, name_lo, name_hi, row = lo[full], hi[full], name_lo[full], name_hi[full], row[full]
        mixed = mix64(self.symbols(kept).astype(np.uint64) + np.uint64(1))
        h = []
        for b in _BASES:
            names, values = run_hashes(mixed, name_lo, name_hi, b), run_hashes(mixed, lo, hi, b)
            h.append(mix64(names * np.uint64(_BASES[1]) ^ mix64(values + np.uint64(b))))
        order = np.lexsort((h[1], h[0], row))
        self.row = row[order]
        self.h = [x[order] for x in h]
        self.runs = np.stack([name_lo, name_hi, lo, hi], axis=1)[order]

    def _empty(self) -> None:
        self.row, self.h = np.empty(0, np.int64), [np.empty(0, np.uint64)] * 2
        self.runs, self.kept = np.empty((0, 4), np.int64), np.empty(0, np.int64)
        self.cps, self.sign = np.empty(0, np.uint32), np.empty(0, bool)

    def symbols(self, places: np.ndarray) -> np.ndarray:
        """What stands at the given places, folded."""
        return np.where(self.sign[places], np.uint32(45), fold_table()[self.cps[places]])

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes a row: the sums over its fields, which may come in any order."""
        out = []
        for h in self.h:
            total = np.zeros(self.rows, np.uint64)
            np.add.at(total, self.row, h)
            out.append(mix64(total).view(np.int64))
        return out[0], out[1]

    def fields(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First field and number of fields of the given rows."""
        first = np.searchsorted(self.row, rows)
        return first, np.searchsorted(self.row, rows, "right") - first


def _counting(cps: np.ndarray, kind: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which code points count, and which of them are signs of numbers.

    Letters, digits and symbols count; of punctuation only what belongs to a number: a point between
    or before digits, the minus of an exponent, a minus that touches a number and joins it to no
    word, and a minus that opens a field, if a number comes next, whatever skipped symbols stand
    between. Elsewhere a minus apart from what follows is a dash between words. A plus that would be
    a sign says nothing."""
    n = cps.size
    prev, nxt = np.zeros_like(kind), np.zeros_like(kind)
    prev[1:], nxt[:-1] = kind[:-1], kind[1:]
    alnum_before = (prev == _LETTER) | (prev == _DIGIT)
    after_e = np.zeros(n, bool)  # 1e-4: a sign after an e that follows a digit
    after_e[2:] = ((cps[1:-1] | 32) == 101) & (kind[:-2] == _DIGIT)
    point = (kind == _POINT) & (nxt == _DIGIT) & (prev != _LETTER)
    number = (kind == _DIGIT) | point
    signs = np.flatnonzero((kind == _MINUS) | (kind == _PLUS))
    sign, plus = np.zeros(n, bool), np.zeros(n, bool)
    if signs.size:
        # What stands before and behind each sign, symbols that are skipped aside.
        solid = np.flatnonzero(kind != _DROP)
        after = np.minimum(np.searchsorted(solid, signs, "right"), solid.size - 1)
        behind = solid[after]
        before = solid[np.maximum(np.searchsorted(solid, signs) - 1, 0)]
        next_number = (behind > signs) & (seg[behind] == seg[signs]) & number[behind]
        inner = (before < signs) & (seg[before] == seg[signs])
        touching = number[np.minimum(signs + 1, n - 1)] & (signs + 1 < n)
        joins = np.where(touching, alnum_before[signs] & ~after_e[signs], inner)
        real = next_number & ~joins
        sign[signs[real & (kind[signs] == _MINUS)]] = True
        plus[signs[real & (kind[signs] == _PLUS)]] = True
    keep = (kind == _LETTER) | (kind == _DIGIT) | (kind == 0) | sign | point
    return keep | (kind == _PLUS) & ~plus, sign


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. (count[0] of them), start[1], .."""
    total = int(count.sum())
    if total == 0:
        return np.empty(0, np.int64)
    base = np.cumsum(count) - count
    return np.arange(total) - np.repeat(base - start, count)


def _flat_only(col: pa.Array) -> pa.Array:
    """Objects within objects, and lists, are rewritten as one flat object of paths; others stay."""
    nested = pc.match_substring_regex(col, r'[:\[,]\s*[\[{]').to_numpy(zero_copy_only=False)
    if not any(x for x in nested if x):
        return col

    def flat(x, path: str, out: list) -> list:
        if isinstance(x, dict):
            for k, v in x.items():
                flat(v, f"{path}/{k}", out)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                flat(v, f"{path}/{i}", out)
        else:
            out.append(f"{json.dumps(path)}: {json.dumps(x)}")
        return out

    texts = col.to_pylist()
    for i in np.flatnonzero(nested == True):  # noqa: E712
        parsed = json.loads(texts[i], parse_float=str, parse_int=str)
        if any(isinstance(v, (dict, list)) for v in parsed.values()):
            texts[i] = "{" + ", ".join(flat(parsed, "", [])) + "}"
    return pa.array(texts, pa.string())


def _unescape(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """JSON's escapes resolved: code points, row offsets, and which of them were escaped."""
    back = cps == _BACK
    literal = np.zeros(cps.size, bool)
    if not back.any():
        return cps, offs, literal
    at = np.flatnonzero(back)
    new_run = np.concatenate([[True], np.diff(at) > 1])
    run_start = at[np.maximum.accumulate(np.where(new_run, np.arange(at.size), 0))]
    escaper = at[(at - run_start) % 2 == 0]
    gone = np.zeros(cps.size, bool)
    gone[escaper] = True
    target = escaper + 1
    target = target[target < cps.size]
    literal[target] = True
    code = cps[target].copy()
    is_u = code == 117
    cps = cps.copy()
    cps[target[~is_u]] = 32  # \n, \t, \", \\ and so on: white space or punctuation, skipped alike
    u = target[is_u]
    u = u[u + 4 < cps.size]
    if u.size:
        digits = cps[u[:, None] + np.arange(1, 5)].astype(np.int64)
        digits = np.where(digits >= 97, digits - 87, np.where(digits >= 65, digits - 55, digits - 48)) & 15
        value = (digits * np.array([4096, 256, 16, 1])).sum(axis=1)
        gone[(u[:, None] + np.arange(1, 5)).ravel()] = True
        high = np.flatnonzero((value >= 0xD800) & (value < 0xDC00))
        high = high[(high + 1 < u.size)]
        high = high[(u[high + 1] == u[high] + 6) & (value[high + 1] >= 0xDC00) & (value[high + 1] < 0xE000)]
        value[high] = 0x10000 + ((value[high] - 0xD800) << 10) + (value[high + 1] - 0xDC00)
        gone[u[high + 1]] = True
        cps[u] = np.where((value >= 0xD800) & (value < 0xE000), 0xFFFD, value)
    kept = np.zeros(cps.size + 1, np.int64)
    np.cumsum(~gone, out=kept[1:])
    return cps[~gone], kept[offs], literal[~gone]


def same_records(a: Folded, rows_a: np.ndarray, b: Folded, rows_b: np.ndarray) -> np.ndarray:
    """Whether row rows_a[i] of ``a`` and rows_b[i] of ``b`` read the same: their fields in the order of
    their hashes, and in each field two pointers over the payloads as they are written."""
    (fa, na), (fb, nb) = a.fields(rows_a), b.fields(rows_b)
    same = na == nb
    pair = np.repeat(np.flatnonzero(same), na[same])
    left, right = a.runs[_ranges(fa[same], na[same])], b.runs[_ranges(fb[same], na[same])]
    for lo, hi in ((0, 1), (2, 3)):
        live = pair[left[:, hi] - left[:, lo] != right[:, hi] - right[:, lo]]
        same[live] = False
    for lo, hi in ((0, 1), (2, 3)):
        x, y, end = left[:, lo].copy(), right[:, lo].copy(), left[:, hi]
        live = np.flatnonzero(same[pair] & (x < end))
        while live.size:
            ahead = np.arange(STEP)
            inside = x[live, None] + ahead < end[live, None]
            at_a = a.kept[np.where(inside, x[live, None] + ahead, x[live, None])]
            at_b = b.kept[np.where(inside, y[live, None] + ahead, y[live, None])]
            differ = (a.symbols(at_a) != b.symbols(at_b)).any(axis=1)
            same[pair[live[differ]]] = False
            x[live] += STEP
            y[live] += STEP
            live = live[same[pair[live]] & (x[live] < end[live])]
    return same


def _collapse(batch: pa.RecordBatch, id_col: str) -> Iterator[pa.RecordBatch]:
    """One row a group of copies within the batch, its smallest id first, with the other ids."""
    for part in slices(batch, "payload"):
        folded = Folded(part.column("payload"))
        h1, h2 = folded.hashes()
        ids = part.column(id_col).to_numpy(zero_copy_only=False)
        _, scope = np.unique(np.array([x or "" for x in part.column("scope").to_pylist()], dtype=object).astype(str), return_inverse=True)
        order = np.lexsort((ids, h2, h1, scope))
        s, a, b = scope[order], h1[order], h2[order]
        head = np.ones(order.size, bool)
        head[1:] = (s[1:] != s[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rep = order[np.maximum.accumulate(np.where(head, np.arange(order.size), 0))]
        other = np.flatnonzero(~head)
        if other.size:
            differs = ~same_records(folded, order[other], folded, rep[other])
            head[other[differs]] = True  # goes on alone; the next stage compares again
        first = np.flatnonzero(head)
        members: list[list[int]] = [[] for _ in first]
        # A colliding row in between must not take over the copies behind it.
        where = {int(order[k]): g for g, k in enumerate(first)}
        for k in np.flatnonzero(~head):
            members[where[int(rep[k])]].append(int(ids[order[k]]))
        rows = pa.array(order[first])
        yield pa.RecordBatch.from_arrays(
            [part.column("scope").take(rows), pa.array(h1[order[first]]), pa.array(h2[order[first]]), part.column(id_col).take(rows), pa.array(members, pa.list_(pa.int64())), part.column("payload").take(rows)],
            ["scope", "h1", "h2", id_col, "members", "payload"],
        )


def _first_like(known: list[tuple[int, Folded]], own: int, record: Folded) -> int:
    """The id of the first record that reads the same, which may be this one."""
    zero = np.zeros(1, np.int64)
    for first, other in known:
        if same_records(record, zero, other, zero)[0]:
            return first
    known.append((own, record))
    return own


def _unite(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows of :func:`_collapse`: the first of each run of equal hashes represents the run."""
    held: pa.RecordBatch | None = None
    odd: dict[tuple, list[tuple[int, Folded]]] = {}
    for big in batches:
        for part in slices(big, "payload"):
            n = part.num_rows
            whole = pa.Table.from_batches([held, part] if held is not None else [part]).combine_chunks().to_batches()[0]
            extra = whole.num_rows - n
            h1, h2 = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            scope = np.array([x or "" for x in whole.column("scope").to_pylist()], dtype=object)
            head = np.ones(whole.num_rows, bool)
            head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (scope[1:] != scope[:-1])
            rep = np.maximum.accumulate(np.where(head, np.arange(head.size), 0))
            ids = whole.column(id_col).to_numpy(zero_copy_only=False)
            rep_id = ids[rep].copy()
            other = np.flatnonzero(~head)
            if other.size:
                need = np.union1d(other, rep[other])
                folded = Folded(whole.column("payload").take(pa.array(need)))
                same = same_records(folded, np.searchsorted(need, other), folded, np.searchsorted(need, rep[other]))
                for k in other[~same]:  # equal hashes of different records: none in practice
                    rep_id[k] = _first_like(odd.setdefault((scope[k], h1[k], h2[k]), []), int(ids[k]), Folded(whole.column("payload").slice(int(k), 1)))
            yield pa.RecordBatch.from_arrays([whole.column("scope").slice(extra), pa.array(rep_id[extra:]), *(whole.column(c).slice(extra) for c in (id_col, "members"))], ["scope", "rep", id_col, "members"])
            held = whole.slice(int(rep[-1]), 1)


def copy_groups(df: DataFrame, id_col: str = "record_id", scope_col: str = "scope_id", payload_col: str = "payload") -> DataFrame:
    """``(scope, rep, id_col, members)``: partial groups of copies; ``rep`` is the smallest id of the
    whole group, ``members`` the further ids that were found equal within a batch.

    Copies have the same scope (null is one scope of its own) and the same record; a field that is
    null, empty or absent is the same. Payloads that are null or no JSON object (cut off, or a name
    given twice) are in no group. Rows with a repeated id are copies of each other.
    """
    readable = F.schema_of_variant(F.try_parse_json(payload_col)).startswith("OBJECT")
    base = df.select(F.col(scope_col).alias("scope"), F.col(id_col), F.col(payload_col).alias("payload")).where(F.col("payload").isNotNull() & readable)
    base = scan_width(base)
    ids = schema_plus(base.select(id_col), "members array<bigint>").fields
    t = type(base.schema)
    scope = base.schema["scope"]
    hashes = schema_plus(base.select("scope"), "h1 bigint, h2 bigint").fields
    local = base.mapInArrow(lambda it: (x for b in it for x in _collapse(b, id_col)), t([*hashes, *ids, base.schema["payload"]]))
    keyed = local.repartition("scope", "h1", "h2").sortWithinPartitions("scope", "h1", "h2", id_col)
    rep = schema_plus(base.select(), f"rep {base.schema[id_col].dataType.simpleString()}").fields
    return keyed.mapInArrow(lambda it: _unite(it, id_col), t([scope, *rep, *ids]))


def copies(df: DataFrame, id_col: str = "record_id", scope_col: str = "scope_id", payload_col: str = "payload") -> DataFrame:
    """``(record_id_a, record_id_b)``: the smallest id of each group of copies with each other one."""
    g = copy_groups(df, id_col, scope_col, payload_col)
    member = F.explode(F.concat(F.array(id_col), "members"))
    return g.select(F.col("rep").alias("record_id_a"), member.alias("record_id_b")).where("record_id_a <> record_id_b").distinct()


def distinct_records(df: DataFrame, id_col: str = "record_id", scope_col: str = "scope_id", payload_col: str = "payload") -> DataFrame:
    """``(record_id, scope_id, n_copies)``: each readable record once, with the number of its rows."""
    g = copy_groups(df, id_col, scope_col, payload_col)
    return g.groupBy(F.col("rep").alias("record_id"), F.col("scope").alias("scope_id")).agg(F.sum(F.size("members") + 1).alias("n_copies"))
