"""Queries of the text operators over the test tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm.copies import copies, distinct_records
from specweave.llm.leakage import leaks
from specweave.llm.lookform import equal_looking, look_classes, normal_form
from specweave.llm.namelist import map_names, match_names
from specweave.llm.subjects import document_subjects
from specweave.llm.tokenize import token_ids
from specweave.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = equal_looking(table(spark, sf_dir, "rejected_claims"), "rejected_id", "quote", ["scope_id"])
    claims = table(spark, sf_dir, "claims", "claim_id", "condition", "provenance.scope_id", "canonical_name")
    conditions = equal_looking(claims, "claim_id", "condition", ["scope_id", "canonical_name"])
    return quotes.select(F.lit("quote").alias("field"), "id_a", "id_b").unionAll(conditions.select(F.lit("condition").alias("field"), "id_a", "id_b"))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "rejected_claims", F.lit("quote").alias("field"), F.col("rejected_id").alias("id"), F.col("quote").alias("text"))
    claims = table(spark, sf_dir, "claims", F.lit("condition").alias("field"), F.col("claim_id").alias("id"), F.col("condition").alias("text"))
    return quotes.unionAll(claims).select("field", "id", normal_form(F.col("text")).alias("form"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = look_classes(table(spark, sf_dir, "rejected_claims"), "rejected_id", "quote", ["scope_id"])
    claims = table(spark, sf_dir, "claims", "claim_id", "condition", "provenance.scope_id", "canonical_name")
    conditions = look_classes(claims, "claim_id", "condition", ["scope_id", "canonical_name"])
    return quotes.select(F.lit("quote").alias("field"), "*").unionAll(conditions.select(F.lit("condition").alias("field"), "*"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "claim_candidates"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_records(table(spark, sf_dir, "claim_candidates"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "canonical_names")
    claims = table(spark, sf_dir, "claims", F.lit("claim").alias("source"), F.col("claim_id").alias("record_id"), F.col("canonical_name").alias("typed"))
    merges = table(spark, sf_dir, "merge_candidates", F.lit("merge_candidate").alias("source"), F.col("candidate_id").alias("record_id"), F.col("key").alias("typed"))
    return map_names(claims.unionAll(merges), entries, F.col("typed")).select("source", "record_id", "name_id").distinct()


def p4_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "claims", F.col("canonical_name").alias("name"))
    names = claims.unionAll(table(spark, sf_dir, "merge_candidates", F.col("key").alias("name"))).where("name is not null").distinct()
    return match_names(names, table(spark, sf_dir, "canonical_names"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_subjects(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subjects")))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_found(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_forms": p1_forms, "p1_classes": p1_classes, "p3_found": p3_found, "p3_records": p3_records, "p4_found": p4_found, "p4_names": p4_names, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_composition": p8_composition}


# Words of documents and items, passages of items, and every run of words of a passage's length.
_LEAKS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
p AS (SELECT item_id, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s, w FROM i WHERE len(w) > 0),
passages AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM p), sizes AS (SELECT DISTINCT n FROM passages),
r AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d JOIN sizes ON len(w) >= n),
runs AS (SELECT DISTINCT doc_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM r)
SELECT DISTINCT doc_id, item_id FROM runs JOIN passages USING (n, t)"""


# What a record's name or value is without white space, letter case and punctuation. Signs, points and
# exponents of numbers are marked first (as a, b, c in private characters) and so stay.
def _folded(x: str) -> str:
    sub = lambda t, pattern, to: f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    t = sub(x, r"(\d[eE])[-−](\d)", "\\1\ue000\\2")
    t = sub(sub(t, r"(\d)\.(\d)", "\\1\ue001\\2"), r"(\d)\.(\d)", "\\1\ue001\\2")
    t = sub(t, r"(^|[^\p{L}\p{M}\p{Nd}.])\.(\d)", "\\1\ue001\\2")
    t = sub(t, r"(^|[^\p{L}\p{M}\p{Nd}])[-−]([\d\x{e001}])", "\\1\ue000\\2")
    t = sub(t, r"^([\p{P}\p{Z}\p{Cc}]*)[-−][\p{P}\p{Z}\p{Cc}]*([\d\x{e001}])", "\ue000\\2")
    return f"lower({sub(t, r'[\p{P}\p{Z}\p{Cc}\p{Cf}−]+', '')})"


_RECORDS = f"""WITH c AS (SELECT record_id, scope_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM claim_candidates),
f AS (SELECT record_id, coalesce(scope_id, '') AS scope_id, {_folded('k')} AS name, {_folded("coalesce(json_extract_string(j, '$.\"' || k || '\"'), '')")} AS value FROM (SELECT *, unnest(json_keys(j)) AS k FROM c WHERE json_type(j) = 'OBJECT')),
r AS (SELECT record_id, scope_id, string_agg(name || chr(30) || value, chr(31) ORDER BY name, value) FILTER (value <> '') AS record FROM f GROUP BY record_id, scope_id),
g AS (SELECT *, min(record_id) OVER (PARTITION BY scope_id, record) AS first, count(*) OVER (PARTITION BY scope_id, record) AS n FROM r)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"{_RECORDS} SELECT first AS record_id_a, record_id AS record_id_b FROM g WHERE record_id <> first",
        "p3_records": f"{_RECORDS} SELECT record_id, scope_id, n AS n_copies FROM g WHERE record_id = first",
        "p7_found": _LEAKS,
    }
