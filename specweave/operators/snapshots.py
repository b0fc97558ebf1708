"""Problem 5: what changed between consecutive full snapshots.

Each snapshot is a set of (item, value digest) entries. Items are bucketed into hash ranges; the
ranges are the leaves of a Merkle tree, and every node's digest is the exclusive or of its
children's. The digests of a snapshot are computed once; trees of consecutive snapshots are compared
from the root down, at each level among the children of nodes that differed only, and entries meet
in ranges whose digests differ. The one shuffle of the entries is by spec, kind and hash range: what
falls into a range is made distinct, digested and compared where it lies, and a spec that holds a
third of all rows is spread over its ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from specweave.session import cut

#: Hash bits that choose the leaf, and bits from a level to the next. 2**12 ranges a snapshot and
#: kind keep a leaf at a few thousand entries for snapshots of ten million.
LEAF_BITS = 12
LEVEL_BITS = 6
_SPREAD = ["spec_id", "kind", "leaf"]

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def comparable_value(value: Column) -> Column:
    """A value as it is compared: numbers by magnitude to 12 significant digits, all else without
    regard to case and outer white space. Null is its own value."""
    bare = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    number = F.when(bare.rlike(_NUMBER), bare.try_cast("double"))
    sized = F.when(number == 0, F.lit("0")).when(F.abs(number) < F.lit(float("inf")), F.format_string("%.11e", number))
    return F.when(value.isNull(), F.lit("\x00")).otherwise(F.coalesce(F.concat(F.lit("#"), sized), F.concat(F.lit("'"), F.lower(bare))))


def consecutive(snapshots: DataFrame) -> DataFrame:
    """``(spec_id, snapshot_no, prev_no)``: each snapshot after a spec's first with the one before."""
    w = W.partitionBy("spec_id").orderBy("snapshot_no")
    return snapshots.select("spec_id", "snapshot_no").distinct().withColumn("prev_no", F.lag("snapshot_no").over(w)).where("prev_no is not null")


def _rows(df: DataFrame, kind: str, item: Column, value: Column) -> DataFrame:
    return df.select("spec_id", "snapshot_no", F.lit(kind).alias("kind"), item.alias("item"), value.alias("val"))


def snapshot_entries(values: DataFrame, conflicts: DataFrame, gaps: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """One row per (spec, snapshot, kind, item) with its leaf and a digest of its value, spread by spec,
    kind and leaf.

    Repeated rows count once; an item given with several values in one snapshot stands for the set.
    """
    key = F.concat_ws("|", F.coalesce("component_id", F.lit("")), F.coalesce("canonical_name", F.lit("")), F.coalesce("condition", F.lit("")))
    v = _rows(values, "value", key, F.xxhash64(comparable_value(F.col("value"))))
    c = _rows(conflicts, "conflict", F.col("contradiction_id"), F.lit(0).cast("bigint"))
    g = _rows(gaps, "gap", F.col("field"), F.lit(0).cast("bigint"))
    rows = v.unionAll(c).unionAll(g).where("spec_id is not null and snapshot_no is not null and item is not null")
    leaf = F.shiftrightunsigned(F.xxhash64("item"), 64 - leaf_bits).cast("int")
    # Few rows repeat, so nothing would be gained by making them distinct before they are sent.
    spread = rows.withColumn("leaf", leaf).repartition(*_SPREAD)
    once = spread.groupBy(*_SPREAD, "snapshot_no", "item", "val").agg(F.lit(1).alias("one"))
    # A set of distinct hashes: its exclusive or and its size.
    return once.groupBy(*_SPREAD, "snapshot_no", "item").agg(F.xxhash64(F.bit_xor("val"), F.count(F.lit(1))).alias("vd"))


def snapshot_changes(values: DataFrame, conflicts: DataFrame, gaps: DataFrame, leaf_bits: int = LEAF_BITS, level_bits: int = LEVEL_BITS) -> DataFrame:
    """``(spec_id, snapshot_no, change_kind, item)``: one row per change against the spec's previous
    snapshot; the first snapshot of a spec yields nothing.

    A spec's snapshots are those with rows in ``values``. Values are added, removed or changed
    (see :func:`comparable_value`); conflicts and gaps are opened or closed. A null condition is the
    empty one. Rows without spec, number or item are left out; load times do not matter; empty tables
    give an empty result; other columns are not read.
    """
    entries = snapshot_entries(values, conflicts, gaps, leaf_bits)
    node = F.xxhash64("item", "vd")  # entries are distinct, so none cancels another
    leaves = entries.groupBy(*_SPREAD, "snapshot_no").agg(F.bit_xor(node).alias("d"), F.count(F.lit(1)).alias("n"))
    levels = {leaf_bits: leaves.withColumnRenamed("leaf", "node")}
    for bits in range(leaf_bits - level_bits, -1, -level_bits):  # each level from the one below
        below = levels[bits + level_bits].withColumn("node", F.shiftright("node", level_bits))
        levels[bits] = below.groupBy("spec_id", "kind", "node", "snapshot_no").agg(F.bit_xor("d").alias("d"), F.sum("n").alias("n"))
    # A snapshot is the new side of its own step and the old side of the next one's.
    steps = consecutive(values)
    turn = F.struct(F.col("snapshot_no").alias("step"), F.lit(True).alias("is_new"))
    old = F.struct(F.col("snapshot_no").alias("step"), F.lit(False).alias("is_new"))
    turns = steps.select("spec_id", "snapshot_no", turn.alias("t")).unionAll(steps.select("spec_id", F.col("prev_no").alias("snapshot_no"), old.alias("t")))
    turns = cut(turns.groupBy("spec_id", "snapshot_no").agg(F.collect_list("t").alias("turns")), "turns")  # two at most
    side = lambda x, c: F.max(F.when(F.col("is_new") == x, F.col(c)))
    differing = None
    for bits in range(leaf_bits % level_bits, leaf_bits + 1, level_bits):
        level = levels[bits].join(turns, ["spec_id", "snapshot_no"]).select("spec_id", "kind", "node", F.inline("turns"), F.xxhash64("d", "n").alias("digest"))
        if differing is not None:
            parent = differing.withColumnRenamed("node", "parent")
            level = level.withColumn("parent", F.shiftright("node", level_bits)).join(parent, ["spec_id", "step", "kind", "parent"], "left_semi")
        both = level.groupBy("spec_id", "kind", "node", "step").agg(side(True, "digest").alias("now"), side(False, "digest").alias("before"))
        differing = both.where("not (now <=> before)").select("spec_id", "kind", "node", "step")
    # The differing leaves with the snapshots that they are to be read from.
    wanted = differing.withColumnRenamed("node", "leaf").join(turns.select("spec_id", "snapshot_no", F.inline("turns")), ["spec_id", "step"])
    touched = entries.join(wanted, [*_SPREAD, "snapshot_no"])
    items = touched.groupBy(*_SPREAD, "step", "item").agg(side(True, "vd").alias("now"), side(False, "vd").alias("before"))
    opened = F.when(F.col("kind") == "value", "value_added").otherwise(F.concat("kind", F.lit("_opened")))
    closed = F.when(F.col("kind") == "value", "value_removed").otherwise(F.concat("kind", F.lit("_closed")))
    what = F.when(F.col("before").isNull(), opened).when(F.col("now").isNull(), closed).otherwise("value_changed")
    return items.where("not (now <=> before)").select("spec_id", F.col("step").alias("snapshot_no"), what.alias("change_kind"), "item")


def resolution_changes(values: DataFrame) -> DataFrame:
    """``(spec_id, snapshot_no, change_kind, item)``: decisions that a spec's values rest on (``resolved_from``)
    and did not in its previous snapshot (``resolution_added``), or no longer do (``resolution_withdrawn``)."""
    held = values.select("spec_id", "snapshot_no", F.col("resolved_from").alias("item")).where("spec_id is not null and item <> ''").distinct()
    steps = consecutive(values.where("spec_id is not null and snapshot_no is not null"))
    now = steps.join(held, ["spec_id", "snapshot_no"]).select("spec_id", F.col("snapshot_no").alias("step"), "item", F.lit(1).alias("now"), F.lit(0).alias("before"))
    prev = held.withColumnRenamed("snapshot_no", "prev_no")
    old = steps.join(prev, ["spec_id", "prev_no"]).select("spec_id", F.col("snapshot_no").alias("step"), "item", F.lit(0).alias("now"), F.lit(1).alias("before"))
    both = now.unionAll(old).groupBy("spec_id", "step", "item").agg(F.max("now").alias("now"), F.max("before").alias("before")).where("now <> before")
    return both.select("spec_id", F.col("step").alias("snapshot_no"), F.when(F.col("now") == 1, "resolution_added").otherwise("resolution_withdrawn").alias("change_kind"), "item")


#: Changes that undo what was built on the snapshot before.
BREAKING = ["value_changed", "value_removed", "resolution_withdrawn", "paper_removed"]


def change_summary(*changes: DataFrame) -> DataFrame:
    """``(spec_id, snapshot_no, n_changes, n_breaking)`` of the snapshots that changed; one without a row is
    identical with the one before it."""
    every = reduce(DataFrame.unionByName, changes)
    return every.groupBy("spec_id", "snapshot_no").agg(F.count(F.lit(1)).alias("n_changes"), F.count_if(F.col("change_kind").isin(BREAKING)).alias("n_breaking"))
