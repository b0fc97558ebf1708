"""Conflicts: claims of several papers on one thing, in one scope, that do not agree.

All detectors have one shape: verified claims, grouped by scope and answer first (few rows a scope,
combined before the shuffle), then by scope; a scope with several papers and several answers is a
conflict whose positions are one representative claim an answer.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from specweave.functions.fuzz import similarity
from specweave.functions.ids import cluster_id, contradiction_id
from specweave.functions.values import digits
from specweave.operators.align import connected_components
from specweave.operators.rules import REVIEWED, SEVERITIES, STRUCTURAL, STRUCTURAL_PROBLEMS
from specweave.session import cut

COSMETIC, RATIO = 1e-9, 10.0
APPROACH_CUT, CRITERION_CUT = 90.0, 88.0
CLOSE_RESULT = 1e-6


def specificity(condition: Column, applies_to: Column, explicit: Column) -> Column:
    """0 to 1: how narrowly a claim says what it is about."""
    s = F.lit(0.5) + F.when(F.coalesce(F.trim(condition), F.lit("")) != "", 0.3).otherwise(0.0) + F.when(F.coalesce(applies_to, F.lit("global")) != "global", 0.1).otherwise(0.0)
    s = s + F.when(explicit == F.lit(False), -0.3).otherwise(0.1)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)), 2)


def reviewed(venue: Column) -> Column:
    return F.when(venue.isNull(), False).otherwise(F.lower(venue).rlike("|".join(REVIEWED)))


def value_severity(name: Column, n_values: Column, n_numeric: Column, low: Column, high: Column) -> Column:
    """How grave a disagreement on a setting is, from the number of values and the extreme ones."""
    structural = name.isin(STRUCTURAL)
    return (
        F.when(n_numeric < n_values, F.when(structural, "BLOCKING").otherwise("MATERIAL"))
        .when(high - low <= COSMETIC, "COSMETIC")
        .when(structural, "BLOCKING")
        .when((low <= 0) | (high <= 0), "BLOCKING")
        .when(high / low >= RATIO, "BLOCKING")
        .otherwise("MATERIAL")
    )


def _given(claims: DataFrame, **defaults: Column) -> DataFrame:
    """``claims`` with the columns that a source may not have, as what their absence means."""
    return claims.withColumns({name: default for name, default in defaults.items() if name not in claims.columns})


def _representative(*more: str) -> Column:
    fields = ["claim_id", "paper_id", "applies_to", "stated_explicitly", "condition", "value", "value_key", *more]
    return F.min_by(F.struct(*fields), "claim_id").alias("rep")


def _supported(position: Column, scoped: Column) -> Column:
    """A position as the rules take it: the representative claim of an answer and how it is stated."""
    spec = specificity(F.col("rep.condition"), F.col("rep.applies_to"), F.col("rep.stated_explicitly"))
    return F.struct(F.col("rep.claim_id").alias("claim_id"), F.col("rep.paper_id").alias("paper_id"), position.alias("position"), spec.alias("specificity"), F.col("rep.stated_explicitly").alias("stated_explicitly"), scoped.alias("has_condition"))


def _unstated(text: str) -> Column:
    return F.when(F.col("rep.stated_explicitly") == F.lit(False), F.lit(f" ({text})")).otherwise(F.lit(""))


def _cluster(kind: str) -> Column:
    return cluster_id(F.lit(kind), F.col("name_key"))


def _conflict_id(kind: str, label: str) -> Column:
    return contradiction_id(_cluster(kind), F.lit(label), F.transform("positions", lambda p: p["claim_id"]))


def value_conflicts(claims: DataFrame) -> DataFrame:
    """Settings given with several values by several papers under one condition and unit."""
    scope = ["name_key", "cond", "unit_key"]
    v = claims.where("status = 'verified' and type = 'hyperparameter' and value_key is not null").withColumn("unit_key", F.coalesce(F.lower(F.trim("unit")), F.lit("")))
    answers = v.groupBy(*scope, "value_key").agg(_representative(), F.min("paper_id").alias("p_lo"), F.max("paper_id").alias("p_hi"), F.min("value_num").alias("num"))
    g = answers.groupBy(*scope).agg(
        F.array_sort(F.collect_list(_supported(F.concat("value_key", F.when(F.col("unit_key") != "", F.concat(F.lit(" "), "unit_key")).otherwise(F.lit("")), _unstated("inferred, not stated")), F.col("cond") != ""))).alias("positions"), F.count(F.lit(1)).alias("n_values"), F.count("num").alias("n_numeric"), F.min("num").alias("low"), F.max("num").alias("high"), F.min("p_lo").alias("p_lo"), F.max("p_hi").alias("p_hi")
    ).where("n_values >= 2 and p_lo <> p_hi")
    sev = value_severity(F.col("name_key"), F.col("n_values"), F.col("n_numeric"), F.col("low"), F.col("high"))
    cluster = cluster_id(F.lit("hyperparameter"), F.col("name_key"))
    ids = F.transform("positions", lambda p: p["claim_id"])
    return g.select(contradiction_id(cluster, F.lit("VALUE_CONFLICT"), ids).alias("contradiction_id"), cluster.alias("cluster_id"), F.lit("VALUE_CONFLICT").alias("conflict_type"), sev.alias("severity"), *scope, "n_values", "low", "high", "positions")


def result_conflicts(claims: DataFrame, relative: float = CLOSE_RESULT) -> DataFrame:
    """Results reported with several numbers by several papers for one metric, dataset, split, model and
    protocol.

    Numbers to ten digits are answers; those within ``relative`` of the last one kept, in order, are
    the same answer. No conflict where every answer has a spread and all lie within each other's.
    ``dataset``, ``split``, ``model_variant``, ``conditions`` (a map) and ``reported_variance`` may be
    absent; what a claim applies to and its condition then scope it. Always MATERIAL."""
    plain = lambda c: F.coalesce(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))
    r = _given(claims, dataset=F.lit(None).cast("string"), split=F.lit(None).cast("string"), model_variant=F.col("applies_to"), reported_variance=F.lit(None).cast("double"))
    protocol = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("conditions")))) if "conditions" in claims.columns else F.col("cond")
    scope = ["name_key", "dataset_key", "split_key", "applies_key", "cond"]
    r = r.where("status = 'verified' and type = 'result' and value_num is not null")
    r = r.withColumns({"dataset_key": plain(F.col("dataset")), "split_key": plain(F.col("split")), "applies_key": plain(F.col("model_variant")), "cond": F.coalesce(protocol, F.lit("")), "spread": F.abs("reported_variance")})
    answers = r.groupBy(*scope, digits(F.col("value_num"), 10).alias("answer")).agg(F.min_by("value_num", "claim_id").alias("num"), F.min_by("spread", "claim_id").alias("spread"), _representative(), F.min("paper_id").alias("p_lo"), F.max("paper_id").alias("p_hi"))
    said = F.concat(F.col("rep.value"), F.coalesce(F.concat(F.lit(" +/- "), F.col("spread").cast("string")), F.lit("")), _unstated("read from a figure"))
    one = F.struct("num", "rep.claim_id", "spread", _supported(said, F.col("cond") != "").alias("support"))
    g = answers.groupBy(*scope).agg(F.array_sort(F.collect_list(one)).alias("answers"), F.min("p_lo").alias("p_lo"), F.max("p_hi").alias("p_hi")).where("p_lo <> p_hi and size(answers) >= 2")
    near = lambda a, b: F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))
    start = F.slice("answers", 1, 1)
    kept = F.aggregate(F.slice("answers", 2, F.greatest(F.size("answers"), F.lit(1))), start, lambda acc, x: F.when(near(F.element_at(acc, -1)["num"], x["num"]), acc).otherwise(F.concat(acc, F.array(x))))
    g = g.withColumn("kept", kept).where("size(kept) >= 2")
    values, spreads = F.transform("kept", lambda p: p["num"]), F.transform("kept", lambda p: p["spread"])
    g = g.where(~spreads_overlap(values, spreads)).withColumn("positions", F.array_sort(F.transform("kept", lambda p: p["support"])))
    return g.select(_conflict_id("result", "RESULT_CONFLICT").alias("contradiction_id"), _cluster("result").alias("cluster_id"), F.lit("RESULT_CONFLICT").alias("conflict_type"), F.lit("MATERIAL").alias("severity"), *scope, F.size("kept").alias("n_values"), F.element_at("kept", 1)["num"].alias("low"), F.element_at("kept", -1)["num"].alias("high"), "positions")


def spreads_overlap(values: Column, spreads: Column) -> Column:
    """Whether every value has a spread and all pairs lie within each other's."""
    pairs = F.arrays_zip(values.alias("v"), spreads.alias("s"))
    inside = F.forall(pairs, lambda a: F.forall(pairs, lambda b: F.abs(a["v"] - b["v"]) <= F.least(a["s"], b["s"])))
    return F.forall(spreads, lambda s: s.isNotNull()) & F.coalesce(inside, F.lit(False))


def approach_forms(text: Column) -> Column:
    """Ways an approach may be written: without its brackets, its initials, each bracketed form."""
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)", " "), r"[^\p{L}\p{N}%]+", " ")))
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    initials = F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    inner = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), 1), lambda x: F.lower(F.trim(x)))
    forms = F.filter(F.array_distinct(F.concat(F.array(plain), F.array(initials), inner)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(forms) > 0, forms).otherwise(F.array(F.lower(F.trim(text))))


def _padded_grams(form: Column) -> Column:
    """Three-letter grams of a text's distinct words, with both ends of each word marked."""
    words = F.array_distinct(F.filter(F.split(form, r"\s+"), lambda w: w != ""))
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 2), lambda i: F.substring(F.concat(F.lit("\x02\x02"), w, F.lit("\x02\x02")), i, F.lit(3)))
    return F.flatten(F.transform(words, of))


def similar_texts(texts: DataFrame, scope: list[str], text: str, forms: Column, cut_at: float) -> DataFrame:
    """``(*scope, l, r)``, l < r: texts of a scope of which some forms are alike by ``cut_at`` or more.

    Texts meet on three-letter grams. If two forms are that much alike, so few letters of one differ
    that they break at most ``3 d`` of its grams, with d / (2 - d) the share that may differ (a word
    subset breaks none); so among its rarest grams, up to one more than that, some gram is in the
    other. Only these are looked up in the other forms' grams: no pair is lost, and grams that most
    texts share bring none together. Every pair that meets is scored exactly."""
    apart = 1 - cut_at / 100
    broken = 3 * 2 * apart / (1 + apart)
    f = texts.select(*scope, text).distinct().select(*scope, F.col(text).alias("text"), F.explode(F.array_distinct(forms)).alias("form"))
    f = f.select(*scope, "text", "form", F.explode(_padded_grams(F.col("form"))).alias("gram")).groupBy(*scope, "text", "form", "gram").agg(F.count(F.lit(1)).alias("n"))
    f = cut(f, "grams")
    common = f.groupBy(*scope, "gram").agg(F.count(F.lit(1)).alias("df"))
    w = W.partitionBy(*scope, "text", "form").orderBy("df", "gram").rowsBetween(W.unboundedPreceding, -1)
    all_of = F.sum("n").over(W.partitionBy(*scope, "text", "form"))
    # Grams are at least as many as the letters and blanks of the form.
    rare = f.join(common, [*scope, "gram"]).withColumns({"before": F.coalesce(F.sum("n").over(w), F.lit(0)), "total": all_of}).where(F.col("before") <= broken * F.col("total"))
    a = rare.select(*scope, "gram", F.col("text").alias("a"), F.col("form").alias("x"))
    b = f.select(*scope, "gram", F.col("text").alias("b"), F.col("form").alias("y"))
    met = a.join(b, [*scope, "gram"]).where("a <> b")
    first = F.col("a") < F.col("b")
    pick = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d))
    pairs = met.select(*scope, F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"), pick("x", "y").alias("x"), pick("y", "x").alias("y")).distinct()
    return pairs.where(similarity(F.col("x"), F.col("y")) >= cut_at).select(*scope, "l", "r").distinct()


def same_approach(texts: DataFrame, scope: list[str], text: str, cut_at: float = APPROACH_CUT, forms: Column | None = None) -> DataFrame:
    """``(*scope, text, answer)``: near-identical texts of a scope share the alphabetically first;
    connected pairs are one answer."""
    near = similar_texts(texts, scope, text, approach_forms(F.col(text)) if forms is None else forms, cut_at)
    node = lambda t: F.concat_ws("\x1f", *scope, t)
    comp = connected_components(near.select(node("l").alias("a"), node("r").alias("b")))
    named = texts.select(*scope, text).distinct().withColumn("node", node(text)).join(comp, "node", "left")
    return named.select(*scope, text, F.coalesce(F.element_at(F.split("component", "\x1f"), -1), F.col(text)).alias("answer"))


def _own(claims: DataFrame, kind: str) -> DataFrame:
    """Verified claims of a kind that a paper makes for itself, not of earlier work."""
    c = _given(claims, attribution=F.lit("own"), adopted=F.lit(True), rationale=F.lit(None).cast("string"), criterion=F.lit(None).cast("string"))
    own = F.coalesce(F.lower(F.trim("attribution")), F.lit("own")) != "prior_work"
    return c.where((F.col("status") == "verified") & (F.col("type") == kind) & own & (F.trim("value") != "")).withColumn("adopted", F.coalesce("adopted", F.lit(True)))


def method_conflicts(claims: DataFrame) -> DataFrame:
    """Design questions on which several papers take different stands under one condition.

    A stand is an approach, adopted or removed (``adopted``, absent: adopted); near-identical
    approaches are one. It is a conflict if two approaches are adopted, or one is adopted here and
    removed there; the latter, and any on a structural question, is BLOCKING. Claims on earlier work
    (``attribution``) do not count."""
    scope = ["name_key", "cond"]
    v = _own(claims, "method").withColumn("text", F.lower(F.trim(F.regexp_replace("value", r"\s+", " "))))
    stands = cut(v.groupBy(*scope, "text", "adopted").agg(_representative("rationale"), F.min("paper_id").alias("p_lo"), F.max("paper_id").alias("p_hi")), "stands")
    merged = stands.join(same_approach(stands, scope, "text", APPROACH_CUT), [*scope, "text"]).groupBy(*scope, "answer", "adopted").agg(F.min_by("rep", "rep.claim_id").alias("rep"), F.min("p_lo").alias("p_lo"), F.max("p_hi").alias("p_hi"))
    said = F.concat(F.when(F.col("adopted"), F.lit("")).otherwise(F.lit("removes ")), F.trim("rep.value"), F.coalesce(F.concat(F.lit(" - "), F.nullif(F.col("rep.rationale"), F.lit(""))), F.lit("")))
    names = lambda used: F.array_sort(F.collect_set(F.when(F.col("adopted") == used, F.col("answer"))))
    g = merged.groupBy(*scope).agg(F.array_sort(F.collect_list(_supported(said, F.col("cond") != ""))).alias("positions"), names(True).alias("adopted"), names(False).alias("removed"), F.min("p_lo").alias("p_lo"), F.max("p_hi").alias("p_hi"))
    disputed = F.size(F.array_intersect("adopted", "removed")) > 0
    g = g.where((F.col("p_lo") != F.col("p_hi")) & ((F.size("adopted") >= 2) | disputed))
    severity = F.when(disputed | F.col("name_key").isin(STRUCTURAL_PROBLEMS), "BLOCKING").otherwise("MATERIAL")
    return g.select(_conflict_id("method", "METHOD_CONFLICT").alias("contradiction_id"), _cluster("method").alias("cluster_id"), F.lit("METHOD_CONFLICT").alias("conflict_type"), severity.alias("severity"), *scope, F.size("positions").alias("n_values"), F.array_join("adopted", " | ").alias("answers"), "positions")


def definition_conflicts(claims: DataFrame) -> DataFrame:
    """Terms that several papers define differently under one condition.

    Compared is the ``criterion`` where there is one, else the definition; near-identical ones are
    one. BLOCKING if any claim of the scope has a criterion, as code would then compute different
    things. Claims on earlier work do not count."""
    scope = ["name_key", "cond"]
    compared = F.coalesce(F.nullif(F.trim("criterion"), F.lit("")), F.col("value"))
    v = _own(claims, "definition").withColumn("text", F.lower(F.trim(compared)))
    answers = cut(v.groupBy(*scope, "text").agg(_representative("criterion"), F.max(F.coalesce(F.trim("criterion"), F.lit("")) != "").alias("strict"), F.min("paper_id").alias("p_lo"), F.max("paper_id").alias("p_hi")), "answers")
    merged = answers.join(same_approach(answers, scope, "text", CRITERION_CUT, F.array("text")), [*scope, "text"]).groupBy(*scope, "answer").agg(F.min_by("rep", "rep.claim_id").alias("rep"), F.max("strict").alias("strict"))
    said = F.coalesce(F.nullif(F.trim("rep.criterion"), F.lit("")), F.trim("rep.value"))
    # The papers of the representatives decide whether several papers disagree.
    g = merged.groupBy(*scope).agg(F.array_sort(F.collect_list(_supported(said, F.col("cond") != ""))).alias("positions"), F.max("strict").alias("strict"), F.array_sort(F.collect_set("answer")).alias("answers"), F.min("rep.paper_id").alias("p_lo"), F.max("rep.paper_id").alias("p_hi")).where("size(positions) >= 2 and p_lo <> p_hi")
    return g.select(_conflict_id("definition", "DEFINITION_CONFLICT").alias("contradiction_id"), _cluster("definition").alias("cluster_id"), F.lit("DEFINITION_CONFLICT").alias("conflict_type"), F.when(F.col("strict"), "BLOCKING").otherwise("MATERIAL").alias("severity"), *scope, F.size("positions").alias("n_values"), F.array_join("answers", " | ").alias("answers"), "positions")


#: The detectors, by the kind of conflict; :func:`register_detector` adds to them.
DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"VALUE_CONFLICT": value_conflicts, "RESULT_CONFLICT": result_conflicts, "METHOD_CONFLICT": method_conflicts, "DEFINITION_CONFLICT": definition_conflicts}


def register_detector(kind: str, detect: Callable[[DataFrame], DataFrame]) -> None:
    """A further detector: from typed claims to conflicts with the columns of :func:`all_conflicts`."""
    DETECTORS[kind] = detect


def all_conflicts(claims: DataFrame) -> DataFrame:
    """Conflicts of all four kinds in one schema; what a kind has not is null."""
    found = [detect(claims) for detect in DETECTORS.values()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    return rows.select("contradiction_id", "cluster_id", "conflict_type", "severity", "name_key", "cond", "unit_key", "applies_key", "n_values", "low", "high", "positions")


def described(found: DataFrame) -> DataFrame:
    """Conflicts with ``description``: what disagrees, under which condition, with the answers."""
    scope = F.when(F.col("cond") != "", F.concat(F.lit(" under '"), "cond", F.lit("'"))).otherwise(F.lit(""))
    answers = F.array_join(F.transform("positions", lambda p: p["position"]), ", ")
    kind = F.col("conflict_type")
    text = (
        F.when(kind == "VALUE_CONFLICT", F.format_string("Papers set %s%s differently: %s.", "name_key", scope, answers))
        .when(kind == "RESULT_CONFLICT", F.format_string("Papers report different %s%s: %s.", "name_key", scope, answers))
        .when(kind == "METHOD_CONFLICT", F.format_string("Papers take different stands on %s%s: %s.", "name_key", scope, answers))
        .otherwise(F.format_string("Papers define %s%s differently: %s.", "name_key", scope, answers))
    )
    return found.withColumn("description", text)


def ranked(found: DataFrame) -> DataFrame:
    """Conflicts in the order of a review: the gravest first, then by id."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0)), F.lit(len(SEVERITIES) + 1))
    return found.orderBy(rank, "contradiction_id")


def positions_with_support(conflicts: DataFrame, papers: DataFrame) -> DataFrame:
    """One row a position, with its paper's venue, year and whether it was reviewed."""
    flat = conflicts.select("contradiction_id", "conflict_type", "severity", F.explode("positions").alias("p")).select("contradiction_id", "conflict_type", "severity", "p.*")
    meta = papers.groupBy("paper_id").agg(F.min("venue").alias("venue"), F.min("year").alias("year"))
    return flat.join(meta, "paper_id", "left").withColumn("peer_reviewed", reviewed(F.col("venue")))
