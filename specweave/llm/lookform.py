"""Problem 1: one form for texts that look the same.

A batch's code points are mapped at once: a table lookup gives each code point the number of code
points it becomes (none for unseen ones), offsets spread the expansions, marks are put into
canonical order by one sort and composed with their letters pair by pair. What becomes one form:
width (full- and half-width forms), kind of space, ligatures (digraphs and Roman numerals among
them), look-alike letters of Latin, Greek, Cyrillic, Armenian, Cherokee and Coptic, letters in
mathematical type faces, unseen characters, and composed against decomposed accents. What stays: letter case,
accents, raised and lowered digits, dashes of different length, visible punctuation, the number of
blanks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specweave.functions.arrowtext import MAX_CP, codepoints, to_strings
from specweave.session import cut

# Letters that are drawn as the letter given, after Unicode's published list of confusable
# characters. Small letters that are drawn as small capitals stand for one another, not for a Latin one.
LOOK_ALIKES = {
    "Cyrillic": {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V"},
    "Greek": {"ο": "o", "ν": "v", "ι": "i", "ρ": "p", "α": "a", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J"},
    "small capitals": {"к": "ᴋ", "κ": "ᴋ", "ĸ": "ᴋ", "т": "ᴛ", "τ": "ᴛ", "н": "ʜ", "м": "ᴍ", "в": "ʙ", "ѡ": "ω", "ԍ": "ɢ"},
    "Latin and Armenian": {"ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ɪ": "i", "օ": "o", "ս": "u", "ց": "g", "հ": "h", "ո": "n", "յ": "j", "զ": "q", "գ": "q", "Օ": "O", "Ս": "U", "Լ": "L"},
    "Cherokee": {"Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꭹ": "Y", "Ꮓ": "Z"},
    "Coptic": {"ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X"},
    "other": {"µ": "μ", "‐": "-", "‑": "-", "﹣": "-", "ʼ": "’"},
}
# Characters that show nothing and are of no format category.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"
# Characters other than space separators that are a blank.
BLANKS = "\t\n\v\f\r\x85  "
# Blocks whose compatibility decompositions are ligatures: presentation forms, Roman
# numerals, Latin digraphs; and blocks of letters and digits in other type faces.
_LIGATURES = (range(0xFB00, 0xFB50), range(0x2160, 0x2180), range(0x0132, 0x0134), range(0x01C4, 0x01CD), range(0x01F1, 0x01F4))
_TYPE_FACES = (range(0x2100, 0x2150), range(0x1D400, 0x1D800))


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """count, start, flat: what each code point becomes; ccc: its class; pairs, made: compositions."""
    look = {a: b for group in LOOK_ALIKES.values() for a, b in group.items()}
    unseen, blanks = set(UNSEEN), set(BLANKS)
    count, start, ccc = np.ones(MAX_CP, np.uint8), np.zeros(MAX_CP, np.int64), np.zeros(MAX_CP, np.uint8)
    flat: list[int] = [0]
    # Ideographs and Hangul syllables stay as they are; nothing is assigned in between.
    for c in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)]:
        ch = chr(c)
        ccc[c] = unicodedata.combining(ch)
        cat = unicodedata.category(ch)
        if ch in blanks or cat == "Zs":
            out = " "
        elif ch in unseen or cat in ("Cf", "Cc") or 0xE0100 <= c <= 0xE01EF:
            out = ""
        else:
            out = ch
            for _ in range(4):  # decomposition and look-alikes feed each other
                step = ""
                for x in out:
                    d = unicodedata.decomposition(x)
                    ligature = d.startswith("<compat>") and any(ord(x) in r for r in _LIGATURES)
                    if d.startswith(("<wide>", "<narrow>")) or ligature or d.startswith("<font>") and any(ord(x) in r for r in _TYPE_FACES):
                        d = "".join(chr(int(p, 16)) for p in d.split(" ")[1:])
                    elif d and not d.startswith("<"):
                        d = unicodedata.normalize("NFD", x)
                    else:
                        d = x
                    step += "".join(look.get(y, y) for y in d)
                if step == out:
                    break
                out = step
            out = "".join(" " if unicodedata.category(x) == "Zs" else x for x in out)
        if out != ch:
            count[c], start[c] = len(out), len(flat)
            flat += map(ord, out)
    pairs, made = [], []
    for c in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)]:
        d = unicodedata.decomposition(chr(c))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(c)) == chr(c):
            a, b = (int(p, 16) for p in d.split(" "))
            pairs.append(a << 21 | b)
            made.append(c)
    order = np.argsort(pairs)
    return count, start, np.array(flat, np.uint32), ccc, np.array(pairs, np.int64)[order], np.array(made, np.uint32)[order]


def look_form(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one form of each text of a batch of code points."""
    count, start, flat, ccc, pairs, made = tables()
    if cps.size == 0 or (cps.min() >= 0x20 and cps.max() < 0x7F):
        return cps, offs
    n = count[cps]
    swapped = np.flatnonzero(start[cps])
    if (n == 1).all():
        out = cps.copy()
        out[swapped] = flat[start[cps[swapped]]]
    else:
        ends = np.cumsum(n, dtype=np.int64)
        offs = np.concatenate([[0], ends])[offs]
        out = np.repeat(cps, n)
        for k in range(int(n.max())):
            at = swapped[n[swapped] > k]
            out[ends[at] - n[at] + k] = flat[start[cps[at]] + k]
    # Canonical order: marks sorted by class behind their starter; rows begin anew.
    cls = ccc[out]
    if (cls > 0).any():
        row = np.zeros(out.size + 1, np.int32)
        np.add.at(row, offs[1:-1], 1)
        row = np.cumsum(row, dtype=np.int32)[:-1]
        if ((cls[1:] > 0) & (cls[:-1] > cls[1:])).any():
            group = np.cumsum((cls == 0) | (np.diff(row, prepend=-1) > 0))
            order = np.lexsort((cls, group))
            out, cls = out[order], cls[order]
        # Composition: in each round every starter takes the first mark behind it that is not
        # blocked; a mark is blocked by one of the same class that stayed.
        for _ in range(8):
            nxt = np.flatnonzero((cls[1:] > 0) & (np.diff(row) == 0)) + 1
            if nxt.size == 0:
                break
            starter = nxt - 1
            if (cls[starter] > 0).any():
                starter = np.maximum.accumulate(np.where(cls == 0, np.arange(out.size), -1))[nxt]
            ok = (starter >= 0) & (row[np.maximum(starter, 0)] == row[nxt])
            ok &= (nxt - 1 == starter) | (cls[nxt - 1] < cls[nxt]) & (cls[nxt - 1] > 0)
            nxt, starter = nxt[ok], starter[ok]
            key = out[starter].astype(np.int64) << 21 | out[nxt].astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, key), pairs.size - 1)
            hit = pairs[at] == key
            nxt, starter, to = nxt[hit], starter[hit], made[at[hit]]
            if nxt.size == 0:
                break
            _, once = np.unique(starter, return_index=True)
            out[starter[once]] = to[once]
            keep = np.ones(out.size, bool)
            keep[nxt[once]] = False
            kept = np.concatenate([[0], np.cumsum(keep)])
            out, cls, row, offs = out[keep], cls[keep], row[keep], kept[offs]
    return _syllables(out, offs)


def _syllables(out: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hangul letters to syllables, by the standard's arithmetic: first + vowel, then + final."""
    if not ((out >= 0x1100) & (out <= 0x11FF)).any():
        return out, offs
    for last in (False, True):
        a, b = out[:-1].astype(np.int64), out[1:].astype(np.int64)
        if last:
            hit = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b <= 0x11C2)
            to = a + b - 0x11A7
        else:
            hit = (a >= 0x1100) & (a <= 0x1112) & (b >= 0x1161) & (b <= 0x1175)
            to = 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28
        at = np.flatnonzero(hit)
        at = at[~np.isin(at + 1, offs)]
        if at.size == 0:
            continue
        out[at] = to[at]
        keep = np.ones(out.size, bool)
        keep[at + 1] = False
        out, offs = out[keep], np.concatenate([[0], np.cumsum(keep)])[offs]
    return out, offs


def one_form(col: pa.Array) -> pa.Array:
    valid = np.ones(len(col), bool) if not col.null_count else col.is_valid().to_numpy(zero_copy_only=False)
    return to_strings(*look_form(*codepoints(col)), valid)


@F.arrow_udf(T.StringType())
def _form(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for col in batches:
        yield one_form(col)


def normal_form(text: Column) -> Column:
    """The one form of ``text``; null stays null, the empty text stays empty. Plain ASCII texts are
    their own form and never leave the JVM's side of the expression."""
    plain = text.rlike(r"\A[\x20-\x7e]*\z")
    return F.when(plain, text).otherwise(_form(F.when(~plain, text)))


def _groups(df: DataFrame, id_col: str, text_col: str, scope_cols: list[str]) -> DataFrame:
    """``(h, k, id, raw, g)``: rows whose scope and form are met with more than one string; ``g`` holds
    both, ``h`` and ``k`` are hashes of them.

    Which groups have several strings is found from hashes alone, combined before they are sent; texts
    are sent only where they are in such a group. Rows written but once are never sent."""
    key = [F.col(c).alias(f"k{i}") for i, c in enumerate(scope_cols)]
    names = [f"k{i}" for i in range(len(key))]
    raw = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("raw"), *key).where("raw <> ''")
    rows = raw.withColumn("form", normal_form(F.col("raw"))).where("trim(form) <> ''")
    h, k = F.xxhash64("form", *names), F.xxhash64(F.lit(7), *reversed(names), "form")
    rows = cut(rows.select("id", "raw", h.alias("h"), k.alias("k"), F.struct("form", *names).alias("g")), "forms")
    r, q = F.xxhash64("raw"), F.hash("raw")
    several = rows.groupBy("h", "k").agg(F.min(r).alias("lo"), F.max(r).alias("hi"), F.min(q).alias("lo2"), F.max(q).alias("hi2")).where("lo <> hi or lo2 <> hi2").select("h", "k")
    return cut(rows.join(several, ["h", "k"], "left_semi").distinct(), "alike")


def equal_looking(df: DataFrame, id_col: str, text_col: str, scope_cols: list[str]) -> DataFrame:
    """``(id_a, id_b)``: pairs of different ids in one scope whose texts look the same though they
    are different strings; ``id_a < id_b``, once each.

    Null and empty texts, and those in which nothing can be seen, are in no pair; null is no scope
    of its own but equal to null. Repeated rows count once. The distinct strings of a group meet on a
    128-bit hash of scope and form and are compared after; then only their members are paired, so a
    group of equal strings never meets itself.
    """
    rows = _groups(df, id_col, text_col, scope_cols)
    strings = rows.select("h", "k", "raw", "g").distinct()
    a, b = (strings.select("h", "k", F.col("raw").alias(f"raw_{x}"), F.col("g").alias(f"g_{x}")) for x in "ab")
    pairs = a.join(b, ["h", "k"]).where("raw_a < raw_b and g_a <=> g_b").select("h", "k", "g_a", "raw_a", "raw_b")
    left, right = (rows.select("h", "k", F.col("g").alias("g_a"), F.col("raw").alias(f"raw_{x}"), F.col("id").alias(y)) for x, y in ("ax", "by"))
    met = pairs.join(left, ["h", "k", "g_a", "raw_a"]).join(right, ["h", "k", "g_a", "raw_b"]).where("x <> y")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def look_classes(df: DataFrame, id_col: str, text_col: str, scope_cols: list[str]) -> DataFrame:
    """``(id, class_id, n_strings, n_members, n_links)``: each row that looks like another one, with the
    smallest id of its class, how many strings and ids the class has and with how many ids this one
    makes a pair. One row an id, however large the class; an id with several texts has a row for each."""
    rows = _groups(df, id_col, text_col, scope_cols)
    strings = rows.groupBy("h", "k", "g", "raw").agg(F.count_distinct("id").alias("same"), F.min("id").alias("first"))
    classes = strings.groupBy("h", "k", "g").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("n_strings"), F.sum("same").alias("n_members")).where("n_strings > 1")
    own = rows.select("h", "k", "id", "raw").join(strings.select("h", "k", "g", "raw", "same"), ["h", "k", "raw"]).join(classes.drop("g"), ["h", "k"])
    return own.select("id", "class_id", "n_strings", "n_members", (F.col("n_members") - F.col("same")).alias("n_links")).distinct()
