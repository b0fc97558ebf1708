"""Problem 4: names typed freely, mapped to the entries of a reference list.

Names are deduplicated and freed of what stands around them; candidates come from an inverted index
of the list's character n-grams (two and three letters), scored by the cosine of their
inverse-frequency weights. Accepted are the entries above a threshold, and of these those within a
margin of the best; an exact check follows for these few: every word of the entry must be written, in
any order, with slips of the pen, as a beginning of at least ``SHORT`` letters, or in the plural; a
word that is itself another word of the list, or like none, makes another name. What no accepted
entry stands up to is reported as unmatched.

The index is searched by a name's rarest n-grams first, and only so far as an entry that shares none
of them could still reach the threshold, so the n-grams that most entries share bring none in.

Remarks are known by their shape (brackets, numbering, what follows an equals sign or a comma) or
learned from the names themselves: a word that is in no entry and stands beside names that are
complete without it, of many entries, is a remark; one that stands in the place of entries' words is
another word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from specweave.session import cut, scan_width

#: Cosine from which an entry is accepted, and how far behind the best one it may be. Fitted on the
#: names of the test tables: of those that write an entry 1 in 2,000 falls below.
THRESHOLD = 0.25
BEHIND = 0.1
#: Slips, or parts of them, by which one of several entries that stand up must lead the others.
MARGIN = 0.05
SHORT = 4
#: Words in an entry of which all orders are tried; longer ones are read in the order given.
MOST_ORDERED = 4
#: Entries that a remark stands beside, as a share of the list's words that it is met with.
REMARK_SHARE = 0.2

# What is a remark by its shape: numbering in front, brackets, what follows an equals sign or a colon,
# what follows a comma and holds a digit, marks at the ends.
_AROUND = r"^\s*\d+\s*[).:]|\([^()]*\)|\[[^\[\]]*\]|[=:][^=:]*$|,[^,]*\d[^,]*$|^[^\w(\[]+|[^\w)\]]+$"


def bare_name(name: str) -> str:
    """The name without what is a remark by its shape."""
    while True:
        short = re.sub(_AROUND, "", name)
        if short == name or not re.search(r"\w", short):
            return name
        name = short


def name_words(name: str) -> list[str]:
    """Words in lower case: split at separators and where a capital follows a small letter."""
    out = []
    for part in re.findall(r"[^\W_]+", bare_name(name)):
        out += [w.lower() for w in re.findall(r"[^\W\d_A-Z]*[A-Z]+(?![^\W\d_A-Z])|[A-Z]?[^\W\d_A-Z]+|\d+", part)] or [part.lower()]
    return out


@lru_cache(maxsize=1 << 16)
def slips(a: str, b: str, most: int) -> int:
    """Letters left out, added, replaced or swapped with their neighbour; most + 1 if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev2, two, row = two, row, [i]
        for j, y in enumerate(b, 1):
            d = min(two[j] + 1, row[j - 1] + 1, two[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def word_cost(typed: str, word: str, known: frozenset[str]) -> float | None:
    """Slips in ``typed`` as a writing of ``word``; None: another word."""
    if typed == word:
        return 0.0
    if typed in (word + "s", word + "es") or word in (typed + "s", typed + "es"):
        return 0.1
    if typed in known:
        return None
    if SHORT <= len(typed) < len(word) and word.startswith(typed):
        return 0.5
    most = 0 if len(word) < 3 else 1 if len(word) < 6 else 2
    d = min(slips(typed, word, most), slips(typed, word + "s", most) + 0.1)
    d += typed[0] != word[0]  # people rarely mistype a word's first letter
    return float(d) if d <= most + 0.1 and d < len(word) - 1 else None


def _in_order(words: list[str], entry: tuple[str, ...], known: frozenset[str]) -> float | None:
    total = 0.0
    for t, w in zip(words, entry, strict=True):
        if (c := word_cost(t, w, known)) is None:
            return None
        total += c
    return total


def _run_together(s: str, entry: tuple[str, ...], known: frozenset[str]) -> float | None:
    """The best way to cut ``s`` into the entry's words."""
    if len(entry) == 1:
        return word_cost(s, entry[0], known)
    best, w = None, entry[0]
    for k in range(max(1, len(w) - 3 if len(w) <= SHORT else min(SHORT, len(w) - 2)), min(len(s), len(w) + 3) + 1):
        if (c := word_cost(s[:k], w, known)) is not None and s[k:] and (r := _run_together(s[k:], entry[1:], known)) is not None and (best is None or c + r < best):
            best = c + r
    return best


def _any_order(words: list[str], entry: tuple[str, ...], known: frozenset[str]) -> float | None:
    """The least slips with each typed word read as another word of the entry: an assignment of
    minimum cost by shortest augmenting paths."""
    n, none = len(entry), 1e6
    costs = [[word_cost(t, w, known) for w in entry] for t in words]
    row_price, col_price = [0.0] * (n + 1), [0.0] * (n + 1)
    taken = [0] * (n + 1)  # by column: the row that has it; rows and columns count from 1
    for i in range(1, n + 1):
        taken[0], j = i, 0
        least, way, seen = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while taken[j]:
            seen[j], row, delta, to = True, taken[j], float("inf"), 0
            for k in range(1, n + 1):
                if not seen[k]:
                    c = costs[row - 1][k - 1]
                    slack = (none if c is None else c) - row_price[row] - col_price[k]
                    if slack < least[k]:
                        least[k], way[k] = slack, j
                    if least[k] < delta:
                        delta, to = least[k], k
            for k in range(n + 1):
                if seen[k]:
                    row_price[taken[k]] += delta
                    col_price[k] -= delta
                else:
                    least[k] -= delta
            j = to
        while j:
            taken[j], j = taken[way[j]], way[j]
    read = sorted((taken[k], costs[taken[k] - 1][k - 1]) for k in range(1, n + 1) if costs[taken[k] - 1][k - 1] is not None)
    return sum(c for _, c in read) if len(read) == n else None


def _run_together_any_order(s: str, entry: tuple[str, ...], known: frozenset[str]) -> float | None:
    """The best way to cut ``s`` into the entry's words in any order; a rest of the name with the
    same words left is read once."""

    @cache
    def best(at: int, left: tuple[str, ...]) -> float | None:
        rest, least = s[at:], None
        if len(left) == 1:
            return word_cost(rest, left[0], known) if rest else None
        for w in dict.fromkeys(left):
            i = left.index(w)
            for k in range(max(1, len(w) - 3 if len(w) <= SHORT else min(SHORT, len(w) - 2)), min(len(rest) - 1, len(w) + 3) + 1):
                if (c := word_cost(rest[:k], w, known)) is not None and (r := best(at + k, left[:i] + left[i + 1 :])) is not None and (least is None or c + r < least):
                    least = c + r
        return least

    return best(0, tuple(sorted(entry)))


def _one_slip_any_order(s: str, entry: tuple[str, ...]) -> bool:
    """Whether ``s`` is the entry's words in some order, run together, with at most one slip. A slip
    touches two neighbours at most, so of three words the first or the last is as it should be."""

    @cache
    def fits(s: str, left: tuple[str, ...]) -> bool:
        if len(left) <= 2:
            return any(slips(s, "".join(order), 1) <= 1 for order in permutations(left))
        rests = ((w, left[:i] + left[i + 1 :]) for i, w in enumerate(left))
        return any(s.startswith(w) and fits(s[len(w) :], rest) or s.endswith(w) and fits(s[: len(s) - len(w)], rest) for w, rest in rests)

    return fits(s, tuple(sorted(entry)))


def name_cost(words: list[str], entry: tuple[str, ...], known: frozenset[str], alias: bool) -> float | None:
    """Slips in the name as a writing of the entry; None: another name."""
    joined, target = "".join(words), "".join(entry)
    if joined == target:
        return 0.0
    if alias:  # short forms are read as they are, in any order; long ones with one slip
        if len(words) == len(entry) and sorted(words) == sorted(entry):
            return 0.0
        if len(target) >= SHORT and joined == target + "s":
            return 0.1
        return 1.0 if len(target) > 5 and joined not in known and slips(joined, target, 1) <= 1 else None
    if len(entry) > MOST_ORDERED:  # too many orders to list
        if len(words) == len(entry):
            return _any_order(words, entry, known)
        c = _run_together_any_order(joined, entry, known)
        return 1.0 if c is None and len(words) == 1 and len(joined) > 7 and _one_slip_any_order(joined, entry) else c
    costs = []
    for order in permutations(entry):
        if len(words) == len(entry):
            costs.append(_in_order(words, order, known))
        if len(words) != len(entry) or len(words) == 1:
            c = _run_together(joined, order, known)
            if c is None and len(words) == 1 and len(joined) > 7 and slips(joined, "".join(order), 1) <= 1:
                c = 1.0  # letters swapped across two words
            costs.append(c)
    return min((c for c in costs if c is not None), default=None)


_SPLIT = T.StructType([T.StructField("name", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [name_words(n or "") for n in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], _SPLIT.names)


def _grams(words: Column) -> Column:
    """The two- and three-letter grams of the words run together; a single letter is its own."""
    s = F.array_join(words, "")
    cut_out = lambda n: F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))
    of = lambda n: F.when(F.length(s) >= n, cut_out(n)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(s) < 2, F.array(s)).otherwise(F.array_distinct(F.concat(of(2), of(3))))


def spellings(entries: DataFrame) -> DataFrame:
    """``(sid, name_id, alias, entry)``: the words of each name and alias of the list."""
    e = entries.select("name_id", F.col("canonical_name").alias("spelling"), F.lit(False).alias("alias"))
    e = e.unionAll(entries.select("name_id", F.explode("aliases").alias("spelling"), F.lit(True).alias("alias"))).where("spelling <> ''").distinct()
    words = e.select("spelling").distinct().mapInArrow(_split, _SPLIT).select(F.col("name").alias("spelling"), F.col("words").alias("entry")).where(F.size("words") > 0)
    sid = F.concat_ws("/", F.col("name_id").cast("string"), F.col("alias").cast("string"), "spelling")
    return cut(e.join(words, "spelling").select(sid.alias("sid"), "name_id", "alias", "entry"), "spellings")


def remark_words(split: DataFrame, spelled: DataFrame) -> DataFrame:
    """``word``: words of the names that are remarks: in no entry's name, and met at the ends of names
    that are complete without them, of at least ``REMARK_SHARE`` as many entries as they are met with
    words of entries. A word that is also a part of longer entries does not make a name complete."""
    own = spelled.where("not alias").select(F.explode("entry").alias("word")).distinct()
    parts = spelled.where(F.size("entry") > 1).select(F.explode("entry").alias("key")).distinct()
    key = lambda ws: F.array_join(ws, "")
    full = spelled.select("name_id", F.explode(F.array_distinct(F.array(key(F.col("entry")), key(F.array_sort("entry"))))).alias("key")).distinct()
    full = full.join(parts, "key", "left_anti")
    n = F.size("words")
    ends = [(1, 0), (0, 1), (1, 1)]
    piece = lambda a, z: F.struct(F.slice("words", 1 + a, F.greatest(n - a - z, F.lit(0))).alias("rest"), F.concat(F.slice("words", 1, a), F.slice("words", F.greatest(n - z + 1, F.lit(1)), z)).alias("off"))
    cases = split.where(n > 1).select(F.explode(F.array(*(piece(a, z) for a, z in ends))).alias("c")).where(F.size("c.rest") > 0)
    beside = cases.select(F.explode(F.array_distinct(F.array(key(F.col("c.rest")), key(F.array_sort("c.rest"))))).alias("key"), "c.off")
    complete = beside.join(full, "key").select(F.explode("off").alias("word"), "name_id").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("complete"))
    pairs = split.where(n > 1).select(F.explode("words").alias("word"), "words").select("word", F.explode("words").alias("other")).where("word <> other").distinct()
    met = pairs.join(own.withColumnRenamed("word", "other"), "other", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("met"))
    found = complete.join(own, "word", "left_anti").join(met, "word", "left")
    return found.where(F.col("complete") >= REMARK_SHARE * F.coalesce("met", F.lit(0))).select("word")


def _readings(split: DataFrame, spelled: DataFrame) -> DataFrame:
    """``(name, turn, words, known)``: the words of a name as they are (turn 0) and, where it differs,
    without remarks at its ends (turn 1); ``known`` are those that are words of the list."""
    own = spelled.where("not alias").select(F.explode("entry").alias("word")).distinct().withColumn("own", F.lit(True))
    remarks = remark_words(split, spelled).withColumn("remark", F.lit(True))
    each = split.select("name", F.posexplode("words").alias("at", "word")).join(own, "word", "left").join(remarks, "word", "left")
    told = each.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "word", "own", "remark"))).alias("w"))  # a name's own words
    solid = F.transform(F.filter("w", lambda x: x["remark"].isNull()), lambda x: x["at"])
    inner = F.filter("w", lambda x: (x["at"] >= F.array_min(solid)) & (x["at"] <= F.array_max(solid)))
    words = lambda c: F.transform(c, lambda x: x["word"])
    known = F.array_distinct(words(F.filter("w", lambda x: x["own"].isNotNull())))
    whole = F.struct(F.lit(0).alias("turn"), words(F.col("w")).alias("words"))
    bare = F.struct(F.lit(1).alias("turn"), words(inner).alias("words"))
    turns = F.when((F.size(inner) > 0) & (F.size(inner) < F.size("w")), F.array(whole, bare)).otherwise(F.array(whole))
    return told.select("name", known.alias("known"), F.inline(turns))


def accepted(readings: DataFrame, spelled: DataFrame) -> DataFrame:
    """``(name, turn, words, known, name_id, alias, entry, score)``: the entries that the weighted cosine
    accepts: at least ``THRESHOLD``, and within ``BEHIND`` of the name's best."""
    entries = spelled.withColumn("entry_grams", _grams(F.col("entry")))
    postings = entries.select("sid", F.explode("entry_grams").alias("gram"))
    total = max(1, spelled.count())
    weights = postings.groupBy("gram").agg(F.log(1 + F.lit(total) / F.count(F.lit(1))).alias("w"))
    postings = cut(postings.join(weights, "gram"), "postings")
    weights = postings.groupBy("gram").agg(F.first("w").alias("w"))
    norms = postings.groupBy("sid").agg(F.sum(F.col("w") ** 2).alias("entry_norm"))
    mine = readings.select("name", "turn", F.explode(_grams(F.col("words"))).alias("gram")).join(weights, "gram", "left")
    mine = mine.groupBy("name", "turn").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("w", F.lit(math.log(1.0 + total))).alias("w"), "gram")), asc=False).alias("g"))
    squares = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
    mine = mine.withColumn("norm", squares(F.col("g")))
    # Rarest first; an n-gram is looked up while it and those behind it could make up the threshold.
    rest = F.transform("g", lambda x, i: F.struct(x["w"].alias("w"), x["gram"].alias("gram"), i.alias("i")))
    open_ = F.filter(rest, lambda x: squares(F.slice("g", x["i"] + 1, F.size("g"))) >= THRESHOLD**2 * F.col("norm"))
    mine = cut(mine.withColumn("open", open_).withColumn("closed", F.col("norm") - squares(F.col("open"))), "grams")
    looked_up = mine.select("name", "turn", F.explode("open").alias("o")).select("name", "turn", F.col("o.gram").alias("gram"), F.col("o.w").alias("w"))
    shared = looked_up.join(postings.select("gram", "sid"), "gram").groupBy("name", "turn", "sid").agg(F.sum(F.col("w") * F.col("w")).alias("shared"))
    met = shared.join(mine.select("name", "turn", "g", "norm", "closed"), ["name", "turn"]).join(entries.select("sid", "entry_grams"), "sid").join(norms, "sid")
    # Even if all n-grams that were not looked up were shared, some pairs stay below: they are not scored.
    size = F.sqrt(F.col("norm") * F.col("entry_norm"))
    hopeful = met.where(F.col("shared") + F.col("closed") >= THRESHOLD * size - 1e-9)
    dot = squares(F.filter("g", lambda x: F.array_contains("entry_grams", x["gram"])))
    scored = hopeful.select("name", "turn", "sid", (dot / size).alias("score")).where(F.col("score") >= THRESHOLD)
    best = F.max("score").over(W.partitionBy("name", "turn"))
    near = scored.withColumn("best", best).where(F.col("score") >= F.col("best") - BEHIND).drop("best")
    return near.join(readings, ["name", "turn"]).join(spelled, "sid").select("name", "turn", "words", "known", "name_id", "alias", "entry", "score")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slips of each accepted entry; entries that the name does not write are left out."""
    for b in batches:
        words, known, entry, alias = (b.column(c).to_pylist() for c in ("words", "known", "entry", "alias"))
        costs = [name_cost(w, tuple(e), frozenset(k), a) for w, k, e, a in zip(words, known, entry, alias, strict=True)]
        rows = pa.array([i for i, c in enumerate(costs) if c is not None], pa.int64())
        kept = pa.array([c for c in costs if c is not None], pa.float64())
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ("name", "turn", "name_id", "score")), kept], ["name", "turn", "name_id", "score", "cost"])


def match_names(names: DataFrame, entries: DataFrame) -> DataFrame:
    """``(name, name_id, score)`` for each row of ``names`` (one column, ``name``, without repeats);
    name_id 0 where no entry is written. Entries: ``name_id, canonical_name, aliases``.

    Null and empty names, and names without a letter, are unmatched. An entry whose name is null is
    left out; null aliases count as none. Of several entries that stand up, the one of fewest slips
    must lead by ``MARGIN``, in slips or else in the cosine.
    """
    spelled = spellings(entries)
    split = cut(scan_width(names.select("name")).mapInArrow(_split, _SPLIT).where(F.size("words") > 0), "split")
    readings = cut(_readings(split, spelled), "readings")
    id_type = entries.schema["name_id"].dataType.simpleString()
    fine = accepted(readings, spelled).mapInArrow(_check, f"name string, turn int, name_id {id_type}, score double, cost double")
    each = fine.groupBy("name", "turn", "name_id").agg(F.min(F.struct("cost", (-F.col("score")).alias("s"))).alias("v"))
    order = W.partitionBy("name").orderBy("turn", "v", "name_id")
    ranked = each.select("name", "name_id", "turn", "v", F.row_number().over(order).alias("rank"), F.lead(F.struct("turn", "v")).over(order).alias("next")).where("rank = 1")
    clear = F.col("next").isNull() | (F.col("next.turn") > F.col("turn")) | (F.col("next.v.cost") - F.col("v.cost") >= MARGIN) | (F.col("next.v.s") - F.col("v.s") >= MARGIN)
    matched = ranked.where(clear).select("name", F.col("name_id").cast("bigint").alias("name_id"), (-F.col("v.s")).alias("score"))
    return names.select("name").join(matched, "name", "left").select("name", F.coalesce("name_id", F.lit(0)).alias("name_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def map_names(rows: DataFrame, entries: DataFrame, name: Column) -> DataFrame:
    """``rows`` whose name is not literally in the list, with ``name_id``; null names get 0.

    Only the distinct names are matched; the result goes back to the rows by an equi-join, in which
    a name that a third of all rows bear is on the side that may be split.
    """
    typed = rows.withColumn("name", F.coalesce(name, F.lit("")))
    literal = entries.select(F.col("canonical_name").alias("name")).where("name is not null").distinct()
    odd = typed.select("name").distinct().join(literal, "name", "left_anti")
    mapping = cut(match_names(odd, entries).select("name", "name_id"), "names")
    return typed.join(mapping, "name").drop("name")
