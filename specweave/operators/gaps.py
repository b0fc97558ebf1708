"""What a corpus does not supply: a checklist against what is present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.functions.ids import gap_id
from specweave.functions.text import strip_suggestion
from specweave.operators.rules import CHECKLIST, TRAINING, checklist_table


#: Shortest beginning that stands for a word, and shortest word that may have a letter replaced.
ABBREVIATION, RESPELT = 4, 5


def _needs(checklist: list[tuple]) -> Column:
    """The checklist as one constant array: it is unfolded next to a row, never joined."""
    return F.array(*(F.struct(F.lit(f).alias("field"), F.array(*map(F.lit, names)).alias("any_of"), F.lit(c).alias("criticality")) for f, names, c in checklist))


def gaps(claims: DataFrame, per: str = "paper_id", checklist: list[tuple] = CHECKLIST) -> DataFrame:
    """Fields of the checklist that no verified claim of a group supplies; a field is supplied by any
    of its names. Groups without any training setting need none."""
    trains = claims.where(F.col("name_key").isin(TRAINING)).select(per).distinct()
    wanted = trains.select(per, F.inline(_needs(checklist)))
    have = claims.where("status = 'verified'").select(per, "name_key").distinct()
    each = wanted.select(per, "field", "criticality", F.explode("any_of").alias("name_key"))
    met = each.join(have, [per, "name_key"], "left_semi").select(per, "field").distinct()
    return wanted.join(met, [per, "field"], "left_anti").select(per, gap_id(F.col(per), F.col("field")).alias("gap_id"), "field", "criticality")


def gap_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("criticality").agg(F.count(F.lit(1)).alias("n_gaps"))


def ablation(claims: DataFrame, checklist: list[tuple] = CHECKLIST) -> DataFrame:
    """Each field of the checklist taken away in turn: in how many groups that had it the gap appears.

    One aggregation over all trials: a group that supplies a field loses it in that field's trial, so
    the gap must appear wherever some other training setting is left."""
    needs = checklist_table(claims.sparkSession, checklist)
    names = needs.select("field", F.explode("any_of").alias("name_key"))
    have = claims.where("status = 'verified'").groupBy("paper_id", "name_key").agg(F.lit(1).alias("one")).drop("one")
    per = claims.where(F.col("name_key").isin(TRAINING)).groupBy("paper_id").agg(F.collect_set("name_key").alias("training"))
    supplied = have.join(F.broadcast(names), "name_key").groupBy("field", "paper_id").agg(F.lit(1).alias("one")).join(F.broadcast(needs), "field").join(per, "paper_id", "left")
    left = F.size(F.array_except(F.coalesce("training", F.array().cast("array<string>")), F.col("any_of"))) > 0
    return supplied.groupBy("field").agg(F.count(F.lit(1)).alias("trials"), F.count_if(left).alias("gap_appears"))


def _tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), r"[_\s-]+"), lambda t: t != ""))


def _alike(a: Column, b: Column) -> Column:
    """Whether two words are one: equal, one the other's beginning of four letters at least, or of five or
    more letters with one of them replaced."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    begins = (short >= ABBREVIATION) & ((F.length(a) <= F.length(b)) & F.startswith(b, a) | (F.length(b) <= F.length(a)) & F.startswith(a, b))
    apart = F.aggregate(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), F.lit(0), lambda n, i: n + F.when(F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)), 1).otherwise(0))
    return (a == b) | begins | ((short == long) & (short >= RESPELT) & (apart == 1))


def same_field(a: Column, b: Column) -> Column:
    """Whether two names mean one field: whatever one has beyond the other abbreviates or respells a word
    of the other, or it has nothing beyond (a qualifier on one side alone). False for empty names."""
    x, y = _tokens(a), _tokens(b)
    covered = lambda p, q: F.forall(F.array_except(p, q), lambda t: F.exists(q, lambda o: _alike(t, o)))
    return (F.size(x) > 0) & (F.size(y) > 0) & (covered(x, y) | covered(y, x))


def _field_keys(name: Column) -> Column:
    """Keys of which two names that mean one field share one: beginnings of words, and both halves of
    each word, of which a replaced letter spoils one."""
    half = lambda t: F.floor(F.length(t) / 2).cast("int")
    keys = lambda t: F.array(t, F.concat(F.lit("^"), F.substring(t, 1, ABBREVIATION)), F.concat(F.length(t).cast("string"), F.lit("<"), F.substring(t, F.lit(1), half(t))), F.concat(F.length(t).cast("string"), F.lit(">"), F.substring(t, half(t) + 1, F.length(t))))
    return F.array_distinct(F.flatten(F.transform(_tokens(name), keys)))


def matching_fields(left: DataFrame, right: DataFrame, per: str) -> DataFrame:
    """``(per, l, r)``: names of both sides (column ``field``) within a group that mean one field. Names meet
    on keys that such names share, so no group meets itself as a whole."""
    l, r = (df.select(per, F.col("field").alias(c)).distinct().withColumn("_k", F.explode(_field_keys(F.col(c)))) for df, c in ((left, "l"), (right, "r")))
    return l.join(r, [per, "_k"]).select(per, "l", "r").distinct().where(same_field(F.col("l"), F.col("r")))


def add_proposed(existing: DataFrame, proposals: DataFrame, supplied: DataFrame, contested: DataFrame, per: str = "paper_id") -> DataFrame:
    """``(per, gap_id, field, question, criticality, origin)``: the gaps there are, and those that a second
    reader proposes: ``proposals`` has ``per, rank, field, question, criticality``.

    Sentences that propose an answer are cut from the questions; a proposal without field or question,
    or of a field proposed before (by ``rank``), is dropped; so is one whose field is ``supplied`` or
    ``contested``, or whose question names a contested one. One that means an existing gap lends it
    its question. What has no known criticality is MATERIAL."""
    question = strip_suggestion(F.col("question"))
    p = proposals.select(per, "rank", F.nullif(F.regexp_replace(F.lower(F.trim("field")), r"[\s-]+", "_"), F.lit("")).alias("field"), F.nullif(question, F.lit("")).alias("question"), F.upper(F.trim("criticality")).alias("criticality"))
    p = p.where("field is not null and question is not null").groupBy(per, "field").agg(F.min_by(F.struct("rank", "question", "criticality"), F.struct("rank", "question")).alias("p")).select(per, "field", "p.*")
    known = matching_fields(p, supplied, per).select(per, F.col("l").alias("field")).distinct()
    p = p.join(known, [per, "field"], "left_anti")
    old = matching_fields(p, existing, per)
    lent = old.join(p, (old[per] == p[per]) & (old["l"] == p["field"])).select(old[per], F.col("r").alias("field"), "rank", "question").groupBy(per, "field").agg(F.max_by("question", "rank").alias("lent"))
    p = p.join(old.select(per, F.col("l").alias("field")).distinct(), [per, "field"], "left_anti")
    at_odds = matching_fields(p, contested, per).select(per, F.col("l").alias("field"))
    words = lambda c: F.translate(F.lower(c), "_", " ")
    c = contested.select(per, F.col("field").alias("about")).distinct()
    named = p.join(c, per).where(F.contains(F.concat_ws(" ", words(F.col("field")), F.lower("question")), words(F.col("about")))).select(per, "field")
    new = p.join(at_odds.union(named).distinct(), [per, "field"], "left_anti")
    rank = F.when(F.col("criticality").isin("BLOCKING", "MATERIAL", "COSMETIC"), F.col("criticality")).otherwise("MATERIAL")
    added = new.select(per, gap_id(F.lit(None).cast("string"), F.col("field")).alias("gap_id"), "field", "question", rank.alias("criticality"), F.lit("proposed").alias("origin"))
    asked = F.col("question") if "question" in existing.columns else F.lit(None).cast("string")
    kept = existing.withColumn("question", asked).join(lent, [per, "field"], "left").select(per, "gap_id", "field", F.coalesce("lent", "question").alias("question"), "criticality", F.lit("checklist").alias("origin"))
    return kept.unionByName(added)
