"""Problem 2: amounts recorded in mixed units and scales, converted to one common unit.

Where the unit is written (in the unit column, else in the value, else beside the same number in
the quote) the conversion is exact rational arithmetic. Where it is written nowhere, a mixture is
fitted for each quantity on the log scale: all amounts of a quantity are taken to share one
log-normal location, and an unwritten unit shifts an amount by that unit's known conversion, so
the components have no free location. The unit is assigned by posterior; below ``CERTAIN`` the row
is flagged. The fit reads a histogram with one row per quantity, origin and bin, whatever the
number of amounts. The prior weight of a component is how often its unit is written, and nothing
else. That a bare number where parts per million are common is a fraction of one is a rule of the
data: the amount is given by the rule, and the posterior says what the amounts make of it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specweave.session import cut, scan_width

#: Posterior from which an assigned unit counts as certain.
CERTAIN = 0.9
BINS_PER_DECADE = 20
EM_ROUNDS = 30
#: Distinct (unit, value, quote) readings a worker remembers.
MEMO = 1 << 14

# SI and binary multiples.
SI = {"n": Fraction(1, 10**9), "µ": Fraction(1, 10**6), "m": Fraction(1, 1000), "c": Fraction(1, 100), "": Fraction(1), "k": Fraction(10**3), "M": Fraction(10**6), "G": Fraction(10**9), "T": Fraction(10**12), "P": Fraction(10**15), "E": Fraction(10**18)}
SI_WORDS = {"nano": "n", "micro": "µ", "milli": "m", "centi": "c", "kilo": "k", "mega": "M", "giga": "G", "tera": "T", "peta": "P", "exa": "E"}
BINARY = {"Ki": Fraction(2**10), "Mi": Fraction(2**20), "Gi": Fraction(2**30), "Ti": Fraction(2**40), "Pi": Fraction(2**50)}
BINARY_WORDS = {"kibi": "Ki", "mebi": "Mi", "gibi": "Gi", "tebi": "Ti", "pebi": "Pi"}
# Scales of counts.
COUNT_SCALES = {10**3: ("k", "K", "thousand", "thousands", "tsd"), 10**6: ("M", "mn", "mln", "mio", "million", "millions"), 10**9: ("B", "bn", "billion", "billions"), 10**12: ("T", "tn", "trillion", "trillions")}
# Common units and the quantity each measures.
KIND_OF = {"ms": "time", "µs": "time", "s": "time", "byte": "data", "bit/s": "rate", "Hz": "frequency", "J": "energy", "mW": "power", "W": "power", "µm": "length", "m": "length", "mK": "temperature", "K": "temperature", "GFLOP": "work", "ppm": "ratio", "steps": "steps", "tokens": "tokens", "parameters": "parameters"}
# Words for "about".
ABOUT = r"(?:~|≈|∼|≃|\b(?:about|around|approximately|approx\.?|circa|ca\.?|c\.|roughly|some|nearly|almost|est\.)(?=[\s\d~+−-]))"
# Units of other kinds of quantity that a quote may have beside a number.
FOREIGN = ("points", "point", "items", "item", "epochs", "epoch", "rounds", "round", "layers", "seeds")


def _spell(kind: str, base: Fraction, shorts: tuple[str, ...], longs: tuple[str, ...], prefixes: str, out: dict) -> None:
    """All spellings of a unit with the given multiples: short forms as written, long ones in words."""
    for p in prefixes.split():
        p = "" if p == "-" else p
        for s in shorts:
            out[(kind, p + s)] = (base * SI[p], 0)
    for word, p in SI_WORDS.items():
        if p in prefixes.split():
            for s in longs:
                out[(kind, word + s)] = (base * SI[p], 0)
    if "-" in prefixes.split():
        for s in longs:
            out[(kind, s)] = (base, 0)


@cache
def unit_table() -> dict[tuple[str, str], tuple[Fraction, Fraction]]:
    """(kind, spelling) -> (factor, offset): amount * factor + offset is in the kind's base unit."""
    t: dict[tuple[str, str], tuple[Fraction, Fraction]] = {}
    one = Fraction(1)
    _spell("time", one, ("s", "sec", "secs"), ("second", "seconds", "sec", "secs"), "n µ m -", t)
    t |= {("time", x): (Fraction(60), 0) for x in ("min", "mins", "minute", "minutes")}
    t |= {("time", x): (Fraction(3600), 0) for x in ("h", "hr", "hrs", "hour", "hours")}
    t |= {("time", x): (Fraction(86400), 0) for x in ("d", "day", "days")}
    t |= {("time", x): (Fraction(604800), 0) for x in ("wk", "wks", "w", "week", "weeks")}
    byte_words = ("byte", "bytes")
    _spell("data", one, ("B", "byte", "bytes"), byte_words, "- k M G T P", t)
    _spell("data", Fraction(1, 8), ("bit", "bits", "b"), ("bit", "bits"), "- k M G T P", t)
    for p, f in BINARY.items():
        t |= {("data", p + s): (f, 0) for s in ("B", "byte", "bytes")} | {("data", p + s): (f / 8, 0) for s in ("bit", "bits", "b")}
    for w, p in BINARY_WORDS.items():
        t |= {("data", w + s): (BINARY[p], 0) for s in byte_words} | {("data", w + s): (BINARY[p] / 8, 0) for s in ("bit", "bits")}
    for (kind, s), (f, _) in list(t.items()):
        if kind == "data":
            per = ("/s", "/sec", " per second", "/second", "ps") if s[-1] in "bBts" else ("/s",)
            t |= {("rate", s + x): (f * 8, 0) for x in per}
    _spell("frequency", one, ("Hz", "hz"), ("hertz",), "m - k M G T", t)
    _spell("energy", one, ("J",), ("joule", "joules"), "m - k M G T", t)
    _spell("energy", Fraction(3600), ("Wh", "W h", "W·h"), ("watt-hour", "watt-hours", "watt hour", "watt hours", "watthour", "watthours"), "m - k M G T", t)
    _spell("power", one, ("W", "Watt", "Watts"), ("watt", "watts"), "n µ m - k M G", t)
    _spell("length", one, ("m",), ("metre", "metres", "meter", "meters"), "n µ m c - k", t)
    t |= {("length", x): (Fraction(1, 10**6), 0) for x in ("micron", "microns")}
    t |= {("length", x): (Fraction(254, 10000), 0) for x in ("in", "inch", "inches", '"', "″")}
    _spell("temperature", one, ("K",), ("kelvin", "kelvins"), "µ m - k", t)
    zero_c, fifth = Fraction(27315, 100), Fraction(5, 9)
    t |= {("temperature", x): (one, zero_c) for x in ("°C", "° C", "℃", "C", "deg C", "degC", "Celsius", "degrees Celsius", "degree Celsius", "degrees C", "deg. C")}
    t |= {("temperature", x): (fifth, zero_c - 32 * fifth) for x in ("°F", "° F", "℉", "F", "deg F", "degF", "Fahrenheit", "degrees Fahrenheit", "degree Fahrenheit", "degrees F", "deg. F")}
    flop = ("FLOP", "FLOPs", "FLOPS", "flop", "flops")
    _spell("work", one, flop, ("flop", "flops"), "- k M G T P E", t)
    per_day = ("/s-day", "/s-days", "/s day", "/s days", "/s·day", "/s·days")
    _spell("work", Fraction(86400), tuple(f + d for f in ("FLOP", "FLOPs", "flop", "F") for d in per_day) + ("F-day", "F-days"), tuple(f + d for f in ("flop", "flops") for d in per_day), "G T P E", t)
    percent, mille, bp, ppm = Fraction(1, 100), Fraction(1, 1000), Fraction(1, 10**4), Fraction(1, 10**6)
    for f, names in ((percent, ("%", "pct", "pct.", "percent", "per cent", "per-cent")), (mille, ("‰", "permille", "per mille", "per mil", "promille")), (bp, ("bp", "bps", "bips", "basis point", "basis points")), (ppm, ("ppm", "parts per million")), (one, ("fraction", "ratio"))):
        t |= {("ratio", x): (f, 0) for x in names}
    for kind, nouns in (("steps", ("step", "steps")), ("tokens", ("token", "tokens")), ("parameters", ("parameter", "parameters", "param", "params"))):
        t |= {(kind, x): (one, 0) for x in nouns}
        for f, names in COUNT_SCALES.items():
            for n in names:
                t[(kind, n)] = (Fraction(f), 0)
                t |= {(kind, f"{n} {x}"): (Fraction(f), 0) for x in nouns}
    return t


def clean_unit(text: str) -> str:
    """A unit as it is looked up: one kind of micro sign and blank, no outer blanks or brackets."""
    s = re.sub(r"\s+", " ", text.replace("μ", "µ").replace("Μ", "µ")).strip(" .()[]")
    return s


@cache
def _spellings(kind: str) -> tuple[dict[str, tuple[Fraction, Fraction]], dict[str, tuple[Fraction, Fraction]]]:
    exact = {s: v for (k, s), v in unit_table().items() if k == kind}
    exact |= {"u" + s[1:]: v for s, v in exact.items() if s[0] == "µ"}
    folded: dict[str, tuple[Fraction, Fraction] | None] = {}
    for s, v in exact.items():
        low = s.lower()
        folded[low] = v if folded.get(low, v) == v else None  # unclear without its case
    return exact, {k: v for k, v in folded.items() if v is not None}


def find_unit(kind: str, text: str) -> tuple[Fraction, Fraction] | None:
    exact, folded = _spellings(kind)
    s = clean_unit(text)
    return exact.get(s) or folded.get(s.lower())


@cache
def _beside(kind: str) -> re.Pattern:
    """A unit directly behind a number: the longest spelling that ends at a word's end."""
    exact, _ = _spellings(kind)
    own = sorted({*exact, *(s.lower() for s in exact if len(s) > 3), *(s.capitalize() for s in exact if len(s) > 3)}, key=len, reverse=True)
    other = sorted({s for (k, s) in unit_table() if k != kind and len(s) > 3} | {*FOREIGN}, key=len, reverse=True)
    alt = lambda xs: "|".join(re.escape(x) for x in xs if x not in ("w",))
    return re.compile(rf"[   ]?(?:(?P<own>{alt(own)})|(?P<other>{alt(other)}))(?![^\W_]|[-/][^\W\d_])")


_GROUP = "[    _'’]"
_BODY = rf"(?:\d{{1,3}}(?:{_GROUP}\d{{3}})+(?!\d)(?:[.,]\d+)?|\d+(?:,\d{{3}}(?!\d))+(?:\.\d+)?|\d+(?:[.,]\d+)?|\.\d+)"
_POWER = r"(?:[eE][+\-−]?\d+(?![\d.])|\s?[×x*·]\s?10(?:(?:\^|\*\*)\(?[+\-−]?\d+\)?|[⁺⁻]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+))?"
NUMBER = re.compile(rf"(?P<sign>[+\-−]?)(?P<body>{_BODY})(?P<power>{_POWER})")
_CLOCK = re.compile(r"(\d+):([0-5]?\d):([0-5]?\d(?:\.\d+)?)")
_TWO_PART = re.compile(rf"(?:{_BODY}\s?[^\W\d_]+\.?[\s,]*){{2,}}")
_PART = re.compile(rf"({_BODY})\s?([^\W\d_]+)")
_UP = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺−", "0123456789-+-")


def read_number(m: re.Match) -> Fraction:
    """The magnitude of a match of ``NUMBER``. A comma before exactly three digits groups thousands,
    any other is a decimal mark."""
    body = re.sub(_GROUP, "", m["body"])
    if re.fullmatch(r"\d+(,\d{3})+(\.\d+)?", body):
        body = body.replace(",", "")
    value = Fraction(body.replace(",", "."))
    if m["power"]:
        p = re.sub(r".*(?:10(?:\^|\*\*)?|[eE])\(?(?=[-+]?\d+\)?$)", "", m["power"].translate(_UP), flags=re.S).strip("()")
        if abs(int(p)) > 400:
            raise ValueError("no amount")
        value *= Fraction(10) ** int(p)
    return -value if m["sign"] in ("-", "−") else value


def _plain(text: str) -> str:
    return re.sub(rf"^(?:\s*{ABOUT})+\s*", "", text.strip()).strip()


@lru_cache(maxsize=MEMO)
def read_amount(kind: str, value: str, unit: str, quote: str) -> tuple[Fraction, Fraction | None, Fraction | None, str] | None:
    """(number, factor, offset, where): what is recorded; factor is None where no unit is written.
    None: no amount, or one of another kind of quantity."""
    text = _plain(value)
    if kind == "time":
        if m := _CLOCK.fullmatch(text):
            h, mi, s = m.groups()
            return int(h) * 3600 + int(mi) * 60 + Fraction(s), Fraction(1), Fraction(0), "clock"
        if _TWO_PART.fullmatch(text + " "):
            total = Fraction(0)
            for number, name in _PART.findall(text):
                if (u := find_unit(kind, name)) is None:
                    return None
                total += read_number(NUMBER.fullmatch(number)) * u[0]
            return total, Fraction(1), Fraction(0), "clock"
    m = NUMBER.match(text)
    if not m:
        return None
    try:
        number = read_number(m)
    except (ValueError, ZeroDivisionError):
        return None
    rest = text[m.end() :].strip()
    if unit.strip():
        u = find_unit(kind, unit)
        if u is None or rest and find_unit(kind, rest) is None:
            return None
        return number, u[0], Fraction(u[1]), "unit"
    if rest:
        u = find_unit(kind, rest)
        return (number, u[0], Fraction(u[1]), "value") if u else None
    foreign = False
    for q in NUMBER.finditer(quote):
        if q.start() and (quote[q.start() - 1].isalnum() or quote[q.start() - 1] in "._,"):
            continue
        try:
            if read_number(q) != number:
                continue
        except (ValueError, ZeroDivisionError):
            continue
        if b := _beside(kind).match(quote, q.end()):
            if b["own"]:
                u = find_unit(kind, b["own"])
                return number, u[0], Fraction(u[1]), "quote"
            foreign = True
    return None if foreign else (number, None, None, "none")


def to_common(common: str, number: Fraction, factor: Fraction, offset: Fraction) -> Fraction:
    kind = KIND_OF[common]
    return (number * factor + offset) / _common_factor(kind, common)


def _common_factor(kind: str, common: str) -> Fraction:
    return find_unit(kind, common)[0]


def round_nearest(x: Fraction) -> int:
    return round(x)


_READ = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("claim_id", "canonical_name", "common_unit")]
    + [T.StructField("number", T.DoubleType()), T.StructField("common_value", T.LongType()), T.StructField("origin", T.StringType()), T.StructField("mixed", T.BooleanType())]
    + [T.StructField(n, T.DoubleType()) for n in ("log_raw", "log_common")]
    + [T.StructField("readings", T.ArrayType(T.LongType())), T.StructField("at", T.IntegerType())]
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for cid, name, common, value, unit, quote in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kind = KIND_OF.get(common)
            got = read_amount(kind, value, unit or "", quote or "") if kind and value else None
            if got is None:
                continue
            number, factor, offset, origin = got
            amount = mixed = log_common = None
            readings = [round_nearest(to_common(common, number, f, o)) for f, o, _ in exact_components(common)] if factor is None and kind == "ratio" else None
            if readings and max(map(abs, readings)) >= 1 << 63:
                continue
            if factor is not None:
                exact = to_common(common, number, factor, offset)
                amount = round_nearest(exact)
                if abs(amount) >= 1 << 63:
                    continue
                mixed = origin == "clock" or factor != _common_factor(kind, common) or offset != 0
                log_common = math.log10(exact) if exact > 0 else None
            try:
                as_float = float(number)
            except OverflowError:
                continue
            out.append((cid, name, common, as_float, amount, origin, mixed, math.log10(number) if number > 0 else None, log_common, readings, None if factor is None else component_of(common).get((factor, offset))))
        cols = list(zip(*out, strict=True)) if out else [[]] * len(_READ)
        types = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], _READ.names)


def amounts(claims: DataFrame, common_units: DataFrame) -> DataFrame:
    """Every amount of a name in ``common_units`` as it is written; see :func:`convert_units`.

    The filter on the names and the column pruning reach the scan's side; only such rows get to the
    text reader. Repeated rows are still repeated here.
    """
    units = common_units.where("canonical_name is not null").dropDuplicates(["canonical_name"]).select("canonical_name", "common_unit")
    rows = claims.select("claim_id", "canonical_name", "value", "unit", "quote").where("value is not null and claim_id is not null")
    named = rows.join(units, "canonical_name").select("claim_id", "canonical_name", "common_unit", "value", "unit", "quote")
    return scan_width(named).mapInArrow(_read, _READ)


@cache
def exact_components(common: str) -> list[tuple[Fraction, Fraction, str]]:
    """The units an amount may silently have been given in, as (factor, offset, unit): one spelling, the
    shortest, for each conversion."""
    seen: dict[tuple[Fraction, Fraction], str] = {}
    for s, (f, o) in _spellings(KIND_OF[common])[0].items():
        key = (f, Fraction(o))
        if key not in seen or len(s) < len(seen[key]):
            seen[key] = s
    return [(f, o, s) for (f, o), s in sorted(seen.items())]


@cache
def component_of(common: str) -> dict[tuple[Fraction, Fraction], int]:
    return {(f, o): i for i, (f, o, _) in enumerate(exact_components(common))}


@cache
def components(common: str) -> list[tuple[str, float, float]]:
    """The same as (unit, factor, offset) to the common unit."""
    base = _common_factor(KIND_OF[common], common)
    return [(s, float(f / base), float(o / base)) for f, o, s in exact_components(common)]


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weights of one quantity's components, and the shared location and spread, by EM over bins."""
    name, common = pdf["canonical_name"].iloc[0], pdf["common_unit"].iloc[0]
    parts = components(common)
    known, bare = pdf[pdf["known"]], pdf[~pdf["known"]]
    out = {"canonical_name": name, "at": range(len(parts)), "unit": [p[0] for p in parts], "factor": [p[1] for p in parts], "shift": [p[2] for p in parts]}
    k, n_known = len(parts), float(known["n"].sum())
    # A unit is left out as often as it is written, so far as the amounts say nothing else.
    seen = np.bincount(known["at"].dropna().astype(int), known.loc[known["at"].notna(), "n"], k)
    prior = (seen + 0.5) / (seen + 0.5).sum()
    weight = prior.copy()
    centre = (bare["bin"].to_numpy(float) + 0.5) / BINS_PER_DECADE
    x = np.power(10.0, centre)[:, None] * np.array(out["factor"]) + np.array(out["shift"])
    log_x, n = np.log10(np.maximum(x, 1e-300)), bare["n"].to_numpy(float)[:, None]
    at = (known["bin"].to_numpy(float) + 0.5) / BINS_PER_DECADE
    w_known = known["n"].to_numpy(float)
    mu = float((at * w_known).sum() / n_known) if n_known else float(np.median(log_x)) if log_x.size else 0.0
    var = float(((at - mu) ** 2 * w_known).sum() / n_known) + 0.01 if n_known else 1.0
    for _ in range(EM_ROUNDS if len(bare) else 0):
        like = weight * np.exp(-((log_x - mu) ** 2) / (2 * var)) + 1e-300
        r = like / like.sum(axis=1, keepdims=True) * n
        weight = (r.sum(axis=0) + k * prior) / (n.sum() + k)
        total = r.sum() + n_known
        mu = float(((r * log_x).sum() + (at * w_known).sum()) / total)
        var = float(((r * (log_x - mu) ** 2).sum() + ((at - mu) ** 2 * w_known).sum()) / total) + 0.01
    return pd.DataFrame({**out, "weight": weight, "mu": mu, "var": var})


def unit_mixtures(read: DataFrame) -> DataFrame:
    """``(canonical_name, at, unit, factor, shift, weight, mu, var)``: the fitted mixture of each quantity."""
    known = F.col("origin") != "none"
    log = F.when(known, F.col("log_common")).otherwise(F.col("log_raw"))
    hist = read.select("canonical_name", "common_unit", known.alias("known"), "at", F.floor(log * BINS_PER_DECADE).alias("bin")).where("bin is not null")
    hist = hist.groupBy("canonical_name", "common_unit", "known", "at", "bin").agg(F.count(F.lit(1)).alias("n"))
    return hist.groupBy("canonical_name").applyInPandas(_fit, "canonical_name string, at int, unit string, factor double, shift double, weight double, mu double, var double")


def _assigned(read: DataFrame) -> DataFrame:
    """Bare positive numbers with the unit that the mixture of their quantity assigns them; where parts
    per million are common, with that of the rule and the mixture's posterior of it."""
    mix = unit_mixtures(read)
    part = F.struct("at", "unit", "factor", "shift", "weight")
    choices = mix.groupBy("canonical_name").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.first("mu").alias("mu"), F.first("var").alias("var"))
    x = lambda p: F.log10(F.greatest(F.col("number") * p["factor"] + p["shift"], F.lit(1e-300)))
    score = F.transform("parts", lambda p: F.struct((F.log(p["weight"]) - (x(p) - F.col("mu")) ** 2 / (2 * F.col("var"))).alias("s"), p["unit"].alias("unit"), p["at"].alias("at"), (F.col("number") * p["factor"] + p["shift"]).alias("v"), ((p["factor"] != 1) | (p["shift"] != 0)).alias("other")))
    ruled = F.col("readings").isNotNull()
    bare = read.where("origin = 'none' and number > 0").join(choices, "canonical_name").withColumn("scores", score).withColumn("best", F.array_max("scores"))
    # A fraction of one is the last of its components.
    bare = bare.withColumn("pick", F.when(ruled, F.try_element_at("scores", F.size("scores"))).otherwise(F.col("best")))
    share = F.exp(F.col("pick")["s"] - F.col("best")["s"]) / F.aggregate("scores", F.lit(0.0), lambda a, p: a + F.exp(p["s"] - F.col("best")["s"]))
    # Exact where the reader has worked the readings out, else as near as a double is.
    v = lambda p: F.coalesce(F.try_element_at("readings", F.col(p)["at"] + 1), F.rint(F.col(p)["v"]).cast("bigint"))
    fine = bare.where(ruled | (F.abs(F.col("best")["v"]) < 9.2e18))
    return fine.select("claim_id", "canonical_name", v("pick").alias("common_value"), "origin", (ruled & F.col("pick")["other"]).alias("mixed"), F.col("pick")["unit"].alias("assigned_unit"), share.alias("posterior"), (share < CERTAIN).alias("uncertain"), F.col("best")["unit"].alias("likely_unit"), v("best").alias("likely_value"))


def _no_likely() -> list[Column]:
    return [F.lit(None).cast("string").alias("likely_unit"), F.lit(None).cast("bigint").alias("likely_value")]


def _flat(read: DataFrame) -> DataFrame:
    """Bare zeros and negative numbers, on no log scale: taken as the rule has it, and flagged."""
    n = read.where("origin = 'none' and number <= 0").where(F.abs("number") < 9.2e18)
    fraction = F.col("readings").isNotNull()
    v = F.when(fraction, F.try_element_at("readings", F.size("readings"))).otherwise(F.rint("number").cast("bigint"))
    return n.select("claim_id", "canonical_name", v.alias("common_value"), "origin", fraction.alias("mixed"), F.when(fraction, "fraction").otherwise(F.col("common_unit")).alias("assigned_unit"), F.lit(0.0).alias("posterior"), F.lit(True).alias("uncertain"), *_no_likely())


def convert_units(claims: DataFrame, common_units: DataFrame) -> DataFrame:
    """``(claim_id, canonical_name, common_value, origin, mixed, assigned_unit, posterior, uncertain,
    likely_unit, likely_value)``, one row per claim with an amount of a name in ``common_units``.

    ``mixed``: the amount is recorded in a unit or scale other than the common one.
    ``origin`` says where the unit stood: ``unit``, ``value``, ``quote``, ``clock`` (hours and minutes) or
    ``none``; in the last case the unit is assigned by the mixture, with its posterior, and the amount
    is never ``mixed``. Where parts per million are common the rule assigns a bare number the fraction of
    one, which is ``mixed``, whatever the mixture holds: ``posterior`` is the mixture's of that fraction.
    ``likely_unit`` and ``likely_value`` are the mixture's own reading of a bare positive number. No row:
    values that are null, empty or no amount, units of another kind of quantity, names that are null or
    not listed. Repeated rows count once. Zero or negative bare numbers carry no scale: they are taken to
    be in the common unit (fractions of one where parts per million are common) and flagged.
    """
    read = cut(amounts(claims, common_units), "amounts")  # read three times below, by the text reader once
    written = read.where("origin <> 'none'").select("claim_id", "canonical_name", "common_value", "origin", "mixed", F.lit(None).cast("string").alias("assigned_unit"), F.lit(1.0).alias("posterior"), F.lit(False).alias("uncertain"), *_no_likely())
    return written.unionAll(_assigned(read)).unionAll(_flat(read)).distinct()


def mixed_amounts(claims: DataFrame, common_units: DataFrame) -> DataFrame:
    """``(claim_id, common_value)``: the claims whose amount is recorded in a unit or scale other than
    the common one, with the amount in the common unit, to the nearest integer (ties to even).

    Bare numbers are cases only where parts per million are common, so the mixture is fitted to the
    quantities that have such numbers. There the rule gives the amount; no posterior takes a case away."""
    read = cut(amounts(claims, common_units), "amounts")
    written = read.where("origin <> 'none' and mixed")
    open_units = read.where(F.col("common_unit").isin([u for u, kind in KIND_OF.items() if kind == "ratio"]))
    bare = _assigned(open_units).where("mixed").unionByName(_flat(open_units).where("mixed"))
    cols = ["claim_id", "common_value"]
    return written.select(*cols).unionAll(bare.select(*cols)).distinct()
