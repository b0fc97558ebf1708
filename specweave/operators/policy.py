"""Ordered rules over conflicts: the first that applies decides, and says why.

A rule table names predicates and selectors; both are columns over an array of positions, so any
number of rules is one projection. What no rule decides is escalated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.operators.rules import NEVER_AUTOMATIC, POLICY

GAP, YEARS = 0.3, 3


def _n(cond: Callable[[Column], Column]) -> Column:
    return F.size(F.filter("positions", cond))


def _sorted(field: str) -> Column:
    return F.reverse(F.array_sort(F.filter(F.transform("positions", lambda p: p[field]), lambda x: x.isNotNull())))


def _recent() -> Column:
    years = _sorted("year")
    newest = F.element_at(years, 1)
    unique = _n(lambda p: p["year"] == newest) == 1
    reviewed = _n(lambda p: (p["year"] == newest) & p["peer_reviewed"]) == 1
    return (F.size(years) >= 2) & F.when(F.size(years) >= 2, (newest - F.element_at(years, -1) >= YEARS) & unique & reviewed).otherwise(False)


PREDICATES: dict[str, Callable[[], Column]] = {
    "always": lambda: F.lit(True),
    "exactly_one_scoped": lambda: (_n(lambda p: p["has_condition"]) == 1) & (F.size("positions") > 1),
    "specificity_gap": lambda: (F.size("positions") >= 2) & (F.element_at(_sorted("specificity"), 1) - F.try_element_at(_sorted("specificity"), F.lit(2)) >= GAP),
    "exactly_one_primary": lambda: _n(lambda p: p["is_primary"]) == 1,
    "year_gap_and_recent_peer_reviewed": _recent,
    "severity_at_least_material": lambda: F.col("severity").isin("MATERIAL", "BLOCKING"),
    "severity_is_cosmetic": lambda: F.col("severity") == "COSMETIC",
}


def _best(*order: str) -> Column:
    """The position that is last by the given fields, then by claim_id."""
    key = lambda p: F.struct(*(p[f].alias(f) for f in order), p["claim_id"].alias("claim_id"))
    return F.array_max(F.transform("positions", key))["claim_id"]


SELECTORS: dict[str, Callable[[], Column]] = {
    "only_scoped": lambda: F.get(F.filter("positions", lambda p: p["has_condition"]), F.lit(0))["claim_id"],
    "highest_specificity": lambda: _best("specificity"),
    "primary": lambda: F.get(F.filter("positions", lambda p: p["is_primary"]), F.lit(0))["claim_id"],
    "most_recent": lambda: _best("year"),
    "first_by_claim_id": lambda: F.array_min(F.transform("positions", lambda p: p["claim_id"])),
}


def resolve(conflicts: DataFrame, rules: Sequence[tuple] = POLICY) -> DataFrame:
    """``rule_fired``, ``outcome``, ``selected_claim_id`` for conflicts with ``positions``.

    A rule decides nothing that is BLOCKING, no conflict of methods or results, nothing without a selector, and no position that is not
    stated explicitly; where a rule wants a human's word the outcome is DEFERRED, the choice a
    suggestion. An unknown predicate or selector is an error at once."""
    for r in rules:
        if r[2] not in PREDICATES or (r[4] is not None and r[4] not in SELECTORS):
            raise ValueError(f"rule {r[0]} names an unknown predicate or selector")
    at = lambda values, k: F.element_at(F.array(*(F.lit(v) for v in values)), k)
    hits = F.array(*(F.col("conflict_type").isin(list(r[1])) & F.coalesce(PREDICATES[r[2]](), F.lit(False)) for r in rules))
    used = sorted({r[4] for r in rules if r[4]})

    def chosen(k: Column) -> Column:
        name, out = at([r[4] or "" for r in rules], k), F.lit(None).cast("string")
        for s in used:
            out = F.when(name == s, SELECTORS[s]()).otherwise(out)
        return out

    def decision(k: Column, choice: Column) -> Column:
        action = at([r[3] for r in rules], k)
        explicit = F.exists("positions", lambda p: (p["claim_id"] == choice) & p["stated_explicitly"])
        escalate = (action == "ESCALATED") | (F.col("severity") == "BLOCKING") | F.col("conflict_type").isin(NEVER_AUTOMATIC) | choice.isNull() | ~F.coalesce(explicit, F.lit(False))
        outcome = F.when(escalate, "ESCALATED").when(at([bool(r[5]) for r in rules], k), "DEFERRED").otherwise(action)
        return F.struct(at([r[0] for r in rules], k).alias("rule"), outcome.alias("outcome"), F.when(~escalate, choice).alias("choice"))

    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit("ESCALATED").alias("outcome"), F.lit(None).cast("string").alias("choice"))
    # Each part is bound to a variable and so computed once, whatever is made of it later.
    d = _bound(F.array_position(hits, True).cast("int"), lambda k: F.when(k == 0, none).otherwise(_bound(chosen(F.greatest(k, F.lit(1))), lambda c: decision(F.greatest(k, F.lit(1)), c))))
    out = conflicts.withColumn("_d", d)
    return out.withColumns({"rule_fired": F.col("_d.rule"), "outcome": F.col("_d.outcome"), "selected_claim_id": F.col("_d.choice")}).drop("_d")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def decided(resolutions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Resolutions with a human's decisions in their place: an upsert by contradiction_id."""
    mine = decisions.select("contradiction_id", F.lit("SELECTED").alias("outcome"), "selected_claim_id", F.lit("human").alias("resolved_by"))
    rest = resolutions.join(mine.select("contradiction_id"), "contradiction_id", "left_anti")
    by = F.col("resolved_by") if "resolved_by" in rest.columns else F.lit("policy")
    return rest.select("contradiction_id", "outcome", "selected_claim_id", by.alias("resolved_by")).unionByName(mine)
