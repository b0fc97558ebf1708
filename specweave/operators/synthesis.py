"""From claims and decisions to one specification, with the gates it must pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.functions.ids import component_id, content_id, slugify
from specweave.operators.rules import KNOWN_SETTINGS
from specweave.session import cut

_SCOPE = ["type", "name_key", "cond"]


def _with_setting(claims: DataFrame) -> DataFrame:
    """``applies_key``: results are told apart by what they apply to as well, other claims are not."""
    setting = F.coalesce(F.lower(F.trim("applies_to")), F.lit(""))
    return claims.withColumn("applies_key", F.when(F.col("type") == "result", setting).otherwise(""))


def disputed_scopes(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Scopes of conflicts that are still open: their values are withheld.

    Scopes carry the claims' type and key, so a conflict on a method says nothing about a result."""
    is_open = resolutions.where(F.col("outcome").isin("ESCALATED", "DEFERRED")).select("contradiction_id")
    kind = F.lower(F.regexp_replace("conflict_type", "_CONFLICT$", ""))
    kind = F.when(kind == "value", "hyperparameter").otherwise(kind)
    setting = F.coalesce("applies_key", F.lit("")) if "applies_key" in conflicts.columns else F.lit("")
    return conflicts.join(is_open, "contradiction_id", "left_semi").select(kind.alias("type"), "name_key", "cond", setting.alias("applies_key")).distinct()


def superseded(claims: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Claims whose value lost: same scope as a selected claim, another value."""
    won = resolutions.where("outcome in ('SELECTED', 'SCOPED') and selected_claim_id is not null").select(F.col("selected_claim_id").alias("claim_id")).distinct()
    scope = [*_SCOPE, "applies_key"]
    claims = _with_setting(claims)
    winners = claims.join(won, "claim_id", "left_semi").select(*scope, F.col("value_key").alias("won")).distinct()
    lost = claims.where("status = 'verified'").join(winners, scope).groupBy("claim_id").agg(F.min(F.col("value_key") != F.col("won")).alias("lost"))
    return lost.where("lost").select("claim_id")


def merge_agreeing(claims: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Verified claims that agree, as one value with the number of its claims and papers; ``value_id``
    leads to the claims by :func:`value_links`. Counted by paper first, so a value that a third of all
    claims give arrives as a row a paper."""
    group = group or ["type", "name_key", "cond", "value_key"]
    v = claims.where("status = 'verified'").select(*group, "claim_id", "paper_id")
    per = v.groupBy(*group, "paper_id").agg(F.min("claim_id").alias("first"), F.count(F.lit(1)).alias("n"))
    out = per.groupBy(*group).agg(F.min("first").alias("exemplar"), F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_papers"))
    return out.withColumn("value_id", value_id(group))


def value_id(group: list[str]) -> Column:
    return content_id("val", *(F.col(c) for c in group))


def value_links(claims: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``(value_id, claim_id)``: the claims behind each value, one row a claim, in no list of any length."""
    group = group or ["type", "name_key", "cond", "value_key"]
    return claims.where("status = 'verified'").select(value_id(group).alias("value_id"), "claim_id")


def _component_values(claims: DataFrame, disputed: DataFrame, lost: DataFrame) -> DataFrame:
    usable = claims.where("status = 'verified' and type = 'hyperparameter'").join(disputed, _SCOPE, "left_anti").join(lost, "claim_id", "left_anti")
    known = F.col("name_key").isin(KNOWN_SETTINGS)
    where = F.when(known, component_id(F.coalesce("applies_to", F.lit("global")))).otherwise(F.concat(F.lit("cmp_"), slugify(F.col("scope_id"))))
    cond = F.when(known | (F.col("cond") != ""), F.col("cond")).otherwise(F.concat(F.lit("reported in section '"), F.coalesce("section", F.lit("")), F.lit("'")))
    return usable.withColumns({"component_id": where, "cond": cond})


COMPONENT_GROUP = ["component_id", "name_key", "cond", "value_key"]


def components(claims: DataFrame, disputed: DataFrame, lost: DataFrame) -> DataFrame:
    """Values of the specification by component: undisputed verified settings; known ones by what
    they apply to, others by paper and section, under the condition that they are reported there."""
    return merge_agreeing(_component_values(claims, disputed, lost), COMPONENT_GROUP)


def component_links(claims: DataFrame, disputed: DataFrame, lost: DataFrame) -> DataFrame:
    """``(value_id, claim_id)`` of :func:`components`."""
    return value_links(_component_values(claims, disputed, lost), COMPONENT_GROUP)


def design_decisions(claims: DataFrame) -> DataFrame:
    """Verified own claims on methods by the component that they apply to, disputed ones among them: one
    row a decision, of a component that may have no values."""
    own = F.coalesce(F.lower(F.trim("attribution")), F.lit("own")) != "prior_work" if "attribution" in claims.columns else F.lit(True)
    adopted = F.coalesce("adopted", F.lit(True)) if "adopted" in claims.columns else F.lit(True)
    m = claims.where((F.col("status") == "verified") & (F.col("type") == "method") & own)
    target = F.coalesce(F.nullif(F.trim("applies_to"), F.lit("")), F.lit("global"))
    return m.select(component_id(target).alias("component_id"), F.col("name_key").alias("sub_problem"), F.trim("value").alias("approach"), adopted.alias("adopted"), "claim_id")


def component_kinds(values: DataFrame, decisions: DataFrame) -> DataFrame:
    """``(component_id, n_values, n_decisions)``: all components, those with values or decisions alone too."""
    v = values.groupBy("component_id").agg(F.count(F.lit(1)).alias("n_values"))
    d = decisions.groupBy("component_id").agg(F.count(F.lit(1)).alias("n_decisions"))
    none = F.lit(0).cast("bigint")
    return v.join(d, "component_id", "full_outer").select("component_id", F.coalesce("n_values", none).alias("n_values"), F.coalesce("n_decisions", none).alias("n_decisions"))


def contribution(papers: DataFrame, claims: DataFrame) -> DataFrame:
    """``(paper_id, contributed)``: verified claims of each paper, 0 for one without."""
    n = claims.where("status = 'verified'").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    return papers.select("paper_id").distinct().join(n, "paper_id", "left").select("paper_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("contributed"))


def contributing_papers(papers: DataFrame, claims: DataFrame) -> DataFrame:
    """Papers with a verified claim at least."""
    return papers.join(claims.where("status = 'verified'").select("paper_id"), "paper_id", "left_semi")


def verification_summary(report: DataFrame) -> DataFrame:
    """One row: totals over the papers' verification reports."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return report.agg(*(n(c) for c in ("total", "n_verified", "n_rejected", "low_confidence", "warned", "by_trace", "by_range")))


def split_conflicts(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Conflicts with ``state``: ``open`` for the MATERIAL ones without a final decision, ``blocking`` for
    the BLOCKING ones, ``resolved`` for those decided; open COSMETIC ones are in no list."""
    r = resolutions.groupBy("contradiction_id").agg(F.max(~F.col("outcome").isin("ESCALATED", "DEFERRED")).alias("final"))
    done = F.coalesce("final", F.lit(False))
    state = F.when(done, "resolved").when(F.col("severity") == "BLOCKING", "blocking").when(F.col("severity") == "MATERIAL", "open")
    return conflicts.join(r, "contradiction_id", "left").withColumn("state", state).drop("final").where("state is not null")


def expected_results(claims: DataFrame, disputed: DataFrame | None = None, lost: DataFrame | None = None) -> DataFrame:
    """Results on which all papers agree: one value for a metric, model and condition. Those of
    ``disputed`` scopes and ``lost`` claims are withheld."""
    r = claims.where("status = 'verified' and type = 'result' and value_num is not null")
    if disputed is not None:
        r = _with_setting(r).join(disputed, [*_SCOPE, "applies_key"], "left_anti")
    if lost is not None:
        r = r.join(lost, "claim_id", "left_anti")
    scope = ["name_key", "applies_to", "cond"]
    g = r.groupBy(*scope, "value_key").agg(F.min("claim_id").alias("claim_id"), F.count_distinct("claim_id").alias("n"))
    return g.groupBy(*scope).agg(F.min("value_key").alias("value_key"), F.max("value_key").alias("_hi"), F.min("claim_id").alias("exemplar"), F.sum("n").alias("n_claims")).where("value_key = _hi").drop("_hi")


def assumptions(claims: DataFrame) -> DataFrame:
    """Verified claims that are inferred and not stated."""
    return claims.where("status = 'verified' and not stated_explicitly").select("claim_id", "paper_id", "type", "name_key", "value_key")


def provenance_closure(links: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: how many references (``value_id, claim_id``) there are, how many lead to a verified claim, to
    one of another status, and nowhere."""
    status = claims.select("claim_id", "status").groupBy("claim_id").agg(F.max("status").alias("status"))
    j = links.select("claim_id").join(status, "claim_id", "left")
    closed, total = F.count_if(F.col("status") == "verified"), F.count(F.lit(1))
    return j.agg(total.alias("total"), closed.alias("closed"), F.count_if(F.col("status") != "verified").alias("unverified"), F.count_if(F.col("status").isNull()).alias("missing"), F.when(total == 0, 1.0).otherwise(F.round(closed / total, 4)).alias("completeness"))


def cycle_members(edges: DataFrame, source: str = "source", target: str = "target", most_rounds: int = 10_000) -> DataFrame:
    """``node``: nodes on a cycle or on a way from one cycle to another; empty for a graph without.

    Nodes that nothing leads to, or that lead nowhere, are peeled off layer by layer; what cannot be
    peeled holds every cycle. That ``most_rounds`` layers are not enough is an error, never a partial
    result."""
    links = cut(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null").distinct(), "dag")
    n = links.count()
    for _ in range(most_rounds):
        if n == 0:
            break
        inner = links.join(links.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(links.select(F.col("s").alias("t")).distinct(), "t", "left_semi")
        links = cut(inner.select("s", "t"), "dag")
        left = links.count()
        if left == n:
            break
        n = left
    else:
        raise RuntimeError(f"links left to peel after {most_rounds} layers")
    return links.select(F.col("s").alias("node")).union(links.select("t")).distinct()


def cycle_path(edges: DataFrame, source: str = "source", target: str = "target") -> list:
    """The nodes of one cycle, from its first one by order on; empty if there is none. Each core node is
    followed by the smallest that it leads to within the core, so a walk along these ends in a cycle;
    only the links of the core are looked up, one a step."""
    core = cycle_members(edges, source, target)
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).join(core.withColumnRenamed("node", "s"), "s", "left_semi").join(core.withColumnRenamed("node", "t"), "t", "left_semi")
    follow = cut(e.groupBy("s").agg(F.min("t").alias("t")), "follow")
    at, seen = follow.agg(F.min("s")).first()[0], []
    while at is not None and at not in seen:
        seen.append(at)
        step = follow.where(F.col("s") == F.lit(at)).first()
        at = step["t"] if step else None
    ring = seen[seen.index(at) :] if at is not None else []
    k = ring.index(min(ring)) if ring else 0
    return ring[k:] + ring[:k]


GATES = ["blocking", "provenance", "cycle", "schema"]


def first_problem(blocking: DataFrame, closure: DataFrame, cycles: DataFrame, errors: DataFrame) -> str | None:
    """The first gate, in order, that a specification does not pass; None if it passes all."""
    failed = {"blocking": lambda: not blocking.isEmpty(), "provenance": lambda: not closure.where("closed < total").isEmpty(), "cycle": lambda: not cycles.isEmpty(), "schema": lambda: not errors.isEmpty()}
    return next((g for g in GATES if failed[g]()), None)


def blocking(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Blocking conflicts without a final decision: while there is one, there is no final spec."""
    final = resolutions.where("outcome not in ('ESCALATED', 'DEFERRED')").select("contradiction_id")
    return conflicts.where("severity = 'BLOCKING'").join(final, "contradiction_id", "left_anti").select("contradiction_id", "conflict_type", "name_key", "cond")


def spec_document(spec_id: str, values: DataFrame, results: DataFrame, open_conflicts: DataFrame, gaps: DataFrame, papers: DataFrame) -> DataFrame:
    """The whole specification as one nested row, for writing as JSON. The parts are what a spec
    holds, not what the corpus holds."""
    named = {"components": values, "expected_results": results, "open_conflicts": open_conflicts, "missing_but_critical": gaps, "source_papers": papers}
    # Each part is packed into one row; the rows are then folded into one by an aggregation.
    packed = [df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name)) for name, df in named.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packed)
    doc = rows.agg(*(F.first(name, ignorenulls=True).alias(name) for name in named))
    return doc.select(F.lit("0.1.0").alias("spec_version"), F.lit(spec_id).alias("spec_id"), *named)
