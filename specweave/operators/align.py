"""Claims of many papers brought together: keys, blocks, clusters, connected components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from specweave.functions.ids import cluster_id
from specweave.session import cut


#: Single-paper keys of a type that a proposer of merges is shown.
MOST_CANDIDATES = 60
# Fields that name a claim, in the order they are tried.
NAMING = ["canonical_name", "sub_problem", "term", "component_id", "name", "label", "metric"]


def alignment_key(*fields: Column, fallback: Column) -> Column:
    """The first field that is not blank, in lower case; else the fallback."""
    return F.coalesce(*(F.nullif(F.lower(F.trim(f)), F.lit("")) for f in fields), fallback)


def blocks(claims: DataFrame) -> DataFrame:
    """Verified claims by type and key: members, papers, aliases, agreement on the value."""
    v = claims.where("status = 'verified'")
    # Counts by value combine before the shuffle; a key that a third of all claims share arrives as
    # one row a value, never as its claims.
    by_value = v.groupBy("type", "name_key", "value_key").agg(F.count(F.lit(1)).alias("n"), F.min("claim_id").alias("first_claim"))
    values = by_value.groupBy("type", "name_key").agg(F.sum("n").alias("n_claims"), F.count(F.lit(1)).alias("n_values"), F.max("n").alias("top"), F.min("first_claim").alias("first_claim"))
    papers = v.groupBy("type", "name_key").agg(F.count_distinct("paper_id").alias("n_papers"))
    agreement = F.when(F.col("n_papers") <= 1, "singleton").when(F.col("n_values") == 1, "unanimous").when(F.col("top") * 2 > F.col("n_claims"), "majority").otherwise("conflicting")
    joined = values.join(papers, ["type", "name_key"])
    return joined.select(cluster_id(F.col("type"), F.col("name_key")).alias("cluster_id"), "type", "name_key", "n_claims", "n_papers", "n_values", "first_claim", agreement.alias("agreement"))


def usual_name(df: DataFrame, group: list[str], name: str) -> DataFrame:
    """The most frequent name of each group, on a tie the alphabetically first."""
    n = df.groupBy(*group, name).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("k"), name)).alias("best")).select(*group, F.col(f"best.{name}").alias(name))


def symbol_map(claims: DataFrame) -> DataFrame:
    """Symbols of papers and the names they stand for, with how many papers use them so."""
    return claims.where("status = 'verified' and trim(paper_symbol) <> ''").groupBy(F.trim("paper_symbol").alias("symbol"), "name_key").agg(F.count_distinct("paper_id").alias("n_papers"))


def single_paper_keys(claims: DataFrame) -> DataFrame:
    """Keys that only one paper uses: candidates for merging with another paper's."""
    v = claims.where("status = 'verified'").groupBy("type", "name_key").agg(F.min("paper_id").alias("paper_id"), F.max("paper_id").alias("last_paper"), F.count(F.lit(1)).alias("n_claims"))
    return v.where("paper_id = last_paper").drop("last_paper")


def safe_merge(left_unit: Column, right_unit: Column, left_type: Column, right_type: Column) -> Column:
    """Keys may be merged unless both have a unit and they differ, or both have a type and only one is
    numeric."""
    numeric = lambda t: t.isin("float", "int")
    return F.coalesce(left_unit == right_unit, F.lit(True)) & F.coalesce(numeric(left_type) == numeric(right_type), F.lit(True))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200) -> DataFrame:
    """``(node, component)``: the smallest node that each node is connected with.

    Rounds of star contraction: every node is linked to the smallest in its neighbourhood, larger
    neighbours first, then smaller ones, until no link changes; the number of rounds grows with the
    logarithm of the component's size. Each round is two aggregations; a hub's links are aggregated
    map-side before the shuffle. Self-links give components of one node; null ends are left out; that
    the links have not settled after ``most_rounds`` is an error, never a partial result.
    """
    all_edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = all_edges.select("u").union(all_edges.select("v")).distinct()
    links = cut(all_edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = (0, None)
    if links.isEmpty():
        return nodes.select(F.col("u").alias("node"), F.col("u").alias("component"))
    for _ in range(most_rounds):
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = links.join(low.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        low2 = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        links = cut(small.where("u <> v").distinct(), "links")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    parents = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(parents, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))


def split_clusters(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Clusters split by given labels: ``members`` (cluster_id, claim_id), ``labels`` (cluster_id,
    claim_id, label). A member without label is a group of its own; the first label counts; clusters
    without any readable label stay whole. Groups are numbered by their smallest claim."""
    tidy = F.nullif(F.lower(F.trim("label")), F.lit(""))
    first = labels.withColumn("label", tidy).where("label is not null").groupBy("cluster_id", "claim_id").agg(F.min("label").alias("label"))
    known = first.select("cluster_id").distinct().withColumn("split", F.lit(True))
    joined = members.join(known, "cluster_id", "left").join(first, ["cluster_id", "claim_id"], "left")
    group = F.when(F.col("split"), F.coalesce("label", F.concat(F.lit("unassigned_"), "claim_id"))).otherwise(F.lit(""))
    grouped = joined.withColumn("label", group)
    heads = grouped.groupBy("cluster_id", "label").agg(F.min("claim_id").alias("head"))
    many = heads.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    # Numbers by a window over the heads, not by a list of them: a cluster may have any number.
    order = F.row_number().over(W.partitionBy("cluster_id").orderBy("head"))
    numbered = grouped.join(heads.withColumn("number", order), ["cluster_id", "label"]).join(many, "cluster_id")
    child = F.when(F.col("n") == 1, F.col("cluster_id")).otherwise(F.concat("cluster_id", F.lit("_"), F.col("number").cast("string")))
    return numbered.select("cluster_id", child.alias("child_id"), "claim_id")


def merge_identical(children: DataFrame, claims: DataFrame) -> DataFrame:
    """Children of one cluster that hold one and the same value and unit are one again, under the first of
    them; a child with a claim without value, or with several values, stays as it is."""
    v = children.join(claims.select("claim_id", "value_key", F.coalesce(F.lower(F.trim("unit")), F.lit("")).alias("unit_key")), "claim_id")
    key = F.struct("value_key", "unit_key")
    one = v.groupBy("cluster_id", "child_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count_if(F.col("value_key").isNull()).alias("open"))
    same = one.where("open = 0 and lo = hi")
    first = same.groupBy("cluster_id", "lo").agg(F.min("child_id").alias("to"))
    moved = same.join(first, ["cluster_id", "lo"]).select("cluster_id", "child_id", "to")
    return children.join(moved, ["cluster_id", "child_id"], "left").select("cluster_id", F.coalesce("to", "child_id").alias("child_id"), "claim_id")


def merge_candidates(claims: DataFrame, most: int | None = MOST_CANDIDATES) -> DataFrame:
    """``(type, name_key, paper_id, claim_id, description)``: keys that only one paper uses, with what
    is known of their role and nothing of their value, for a proposer to read. ``most`` a type, the
    first by key: what a proposer can read at a time; None lists all."""
    v = claims.where("status = 'verified'")
    per = v.groupBy("type", "name_key").agg(F.min("paper_id").alias("paper_id"), F.max("paper_id").alias("last"), F.min(F.struct("claim_id", "unit", "applies_to", "section")).alias("first")).where("paper_id = last")
    said = lambda c: F.when((F.trim(c) != "") & (F.trim(c) != "global"), F.trim(c))
    parts = F.array(F.translate("name_key", "_", " "), said(F.col("first.unit")), said(F.col("first.applies_to")), F.concat(F.lit("(section: "), F.nullif(F.col("first.section"), F.lit("")), F.lit(")")))
    text = F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())), " ")
    out = per.select("type", "name_key", "paper_id", F.col("first.claim_id").alias("claim_id"), text.alias("description"))
    if most is None:
        return out
    # The first of each type through its first keys alone: no type is sorted as a whole.
    rank = F.row_number().over(W.partitionBy("type").orderBy("name_key", "paper_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def valid_merges(proposals: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(type, proposal, name_key)``: what remains of proposed groups ``(type, proposal, name_key)``: keys
    that are candidates, each for the first proposal that names it only; groups of two keys and two
    papers at least. A group falls as a whole and then claims nothing; proposals of a type are few and
    are judged in order by one fold."""
    known = proposals.where("proposal is not null").join(candidates.select("type", "name_key", "paper_id"), ["type", "name_key"]).distinct()
    listed = known.groupBy("type", "proposal").agg(F.array_sort(F.collect_set(F.struct("name_key", "paper_id"))).alias("members"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for r in pdf.sort_values("proposal").itertuples():
            free = [m for m in r.members if m["name_key"] not in taken]
            if len(free) >= 2 and len({m["paper_id"] for m in free}) >= 2:
                taken |= {m["name_key"] for m in free}
                out += [(r.type, r.proposal, m["name_key"]) for m in free]
        return pd.DataFrame(out, columns=["type", "proposal", "name_key"])

    return listed.groupBy("type").applyInPandas(judge, "type string, proposal int, name_key string")


def merged_keys(claims: DataFrame, merges: DataFrame) -> DataFrame:
    """``(type, name_key, merged_key)``: keys of valid groups under the most frequent key of those that may
    be merged with it (see :func:`safe_merge`), on a tie the alphabetically first."""
    v = claims.where("status = 'verified'").join(merges, ["type", "name_key"])
    per = v.groupBy("type", "proposal", "name_key").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("unit", "value_type"), "claim_id").alias("first"))
    lead = per.groupBy("type", "proposal").agg(F.min(F.struct((-F.col("n")).alias("k"), "name_key", "first")).alias("lead"))
    joined = per.join(lead, ["type", "proposal"])
    safe = safe_merge(F.col("lead.first.unit"), F.col("first.unit"), F.col("lead.first.value_type"), F.col("first.value_type"))
    return joined.where(safe).select("type", "name_key", F.col("lead.name_key").alias("merged_key"))


def cluster_members(claims: DataFrame) -> DataFrame:
    """``(cluster_id, claim_id, paper_id, symbol)``: who is in a cluster, one row a claim; a key that a third
    of all claims share makes no longer row than any other."""
    v = claims.where("status = 'verified'")
    return v.select(cluster_id(F.col("type"), F.col("name_key")).alias("cluster_id"), "claim_id", "paper_id", F.nullif(F.trim("paper_symbol"), F.lit("")).alias("symbol"))


def aligned(claims: DataFrame, fallback: str = "claim_id") -> DataFrame:
    """Claims with ``name_key``: the first of the fields that name them, else their id."""
    fields = [F.col(c) for c in NAMING if c in claims.columns]
    return claims.withColumn("name_key", alignment_key(*fields, fallback=F.col(fallback)))
