"""Claims: one row each, typed values, admission of candidates, checks, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from specweave.functions.ids import content_id, quote_hash, squeezed
from specweave.functions.text import numbers_in, parse_json_reply
from specweave.functions.values import as_number, close, condition_key, value_key
from specweave.operators.documents import find_spans, resolve_spans
from specweave.operators.rules import FIDELITY_CONFIDENCE, KNOWN_SETTINGS, OTHER_CONFIDENCE, range_rules, spelling_table

CONFIDENT = 0.6
WARNED = 0.8


def once(claims: DataFrame) -> DataFrame:
    """Claims delivered again under one id, once: the latest delivery. One shuffle by id, in which few
    rows share a key, so nothing would be gained by aggregating before it."""
    return ranked_first(claims, ["claim_id"], [F.col("loaded_at").desc()])


def setting_name(name: Column) -> Column:
    """A name in its plain form: lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_")


def canonical_names(claims: DataFrame, name: str = "canonical_name") -> DataFrame:
    """``name_key``: the plain name, or what it is a known spelling of for claims of its type. Metrics are
    looked up as they are written, other names in their plain form."""
    known = F.broadcast(spelling_table(claims.sparkSession).withColumnRenamed("type", "_type"))  # a fixed list
    plain = claims.withColumn("plain_name", setting_name(F.col(name)))
    looked_up = F.when(F.col("type") == "result", F.lower(F.trim(name))).otherwise(F.col("plain_name"))
    named = plain.join(known, (F.col("type") == F.col("_type")) & (looked_up == F.col("spelling")), "left")
    return named.withColumn("name_key", F.coalesce("stands_for", "plain_name")).drop("spelling", "stands_for", "plain_name", "_type")


def typed(claims: DataFrame) -> DataFrame:
    """Claims with ``value_num``, ``value_key`` and ``cond``."""
    return claims.withColumns({"value_num": as_number(F.col("value")), "value_key": value_key(F.col("value")), "cond": condition_key(F.col("condition"))})


# Candidates ------------------------------------------------------------------------------------

_FIELDS = ("canonical_name", "value", "value_type", "unit", "applies_to", "condition", "stated_explicitly", "quote")


def read_candidates(candidates: DataFrame) -> DataFrame:
    """Fields of raw replies; ``reply`` is null where nothing can be read."""
    parsed = candidates.withColumn("reply", parse_json_reply(F.col("payload")))
    field = lambda f: F.try_variant_get("reply", f"$.{f}", "string").alias(f)
    return parsed.select(*[c for c in candidates.columns if c not in _FIELDS], "reply", *map(field, _FIELDS))


def admit(candidates: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Candidates with ``reject_reason`` (null: admitted) and a content-derived ``claim_id``; of equal
    claims the first record is kept, the others are marked ``duplicate``.

    With ``texts`` (paper_id, doc_id, text) a quote must stand in its paper, white space aside; ``doc_id``
    and ``at`` then say where it does first."""
    c = read_candidates(candidates)
    missing = F.lit(False)
    if texts is not None:
        quotes = c.select("record_id", "paper_id", F.col("quote").alias("needle"))
        c = c.join(find_spans(quotes, texts, "paper_id", "record_id", "doc_id"), "record_id", "left")
        missing = F.col("doc_id").isNull()
    name = setting_name(F.col("canonical_name"))
    reason = (
        F.when(F.col("reply").isNull(), "unreadable reply")
        .when(F.coalesce(F.trim("quote"), F.lit("")) == "", "no supporting quote supplied")
        .when(missing, "quote does not appear in the document")
        .when(F.coalesce(name, F.lit("")) == "", "schema violation: canonical_name")
        .when(~name.rlike(r"^[a-z][a-z0-9_]*$"), "schema violation: canonical_name")
        .when(F.col("value").isNull(), "schema violation: value")
    )
    keyed = c.withColumns({"reject_reason": reason, "name_key": name, "claim_id": content_id("clm", F.col("paper_id"), F.col("scope_id"), name, value_key(F.col("value")), condition_key(F.col("condition")), squeezed(F.col("quote")))})
    first = keyed.where("reject_reason is null").groupBy("claim_id").agg(F.min("record_id").alias("first_record"))
    marked = keyed.join(first, "claim_id", "left")
    again = F.col("reject_reason").isNull() & (F.col("record_id") != F.col("first_record"))
    return marked.withColumn("reject_reason", F.when(again, "duplicate").otherwise(F.col("reject_reason"))).drop("first_record", "reply")


def vote(claims: DataFrame, passes: int) -> DataFrame:
    """Self-consistency: per (paper, type, name, value) the passes that agree, the first claim, and
    its confidence in proportion. ``claims`` has a column ``pass``."""
    keyed = claims.groupBy("paper_id", "type", F.lower("canonical_name").alias("name_key"), "value_key")
    agreed = keyed.agg(F.countDistinct("pass").alias("k"), F.min_by(F.struct("claim_id", "confidence"), F.struct("pass", "claim_id")).alias("first"))
    share = F.bround(F.col("first.confidence") * F.col("k") / passes, 4)
    return agreed.select("paper_id", "type", "name_key", "value_key", F.col("first.claim_id").alias("claim_id"), share.alias("confidence"), F.concat(F.col("k").cast("string"), F.lit(f"/{passes}")).alias("self_consistency"))


# Checks ----------------------------------------------------------------------------------------


def range_check(claims: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``range_result`` of typed claims by ``name_key``: pass, warn, fail or n/a.

    The rules are a short fixed list and are broadcast; a caller's own list is joined as the planner
    sees fit."""
    table = F.broadcast(range_rules(claims.sparkSession)) if rules is None else rules
    v = F.col("value_num")
    result = (
        F.when(F.col("name").isNull() | (F.col("type") != "hyperparameter"), "n/a")
        .when(v.isNull() | (F.col("value_type") == "bool"), "fail")
        .when(F.col("positive") & (v <= 0), "fail")
        .when((v < F.col("hard_lo")) | (v > F.col("hard_hi")), "fail")
        .when((v < F.col("soft_lo")) | (v > F.col("soft_hi")), "warn")
        .otherwise("pass")
    )
    joined = claims.join(table, F.col("name_key") == F.col("name"), "left")
    return joined.withColumn("range_result", result).drop("name", "kind", "hard_lo", "hard_hi", "soft_lo", "soft_hi", "positive")


def numeric_check(claims: DataFrame) -> DataFrame:
    """``numeric_result``: whether the number claimed stands in the quote (pass or warn; n/a if none)."""
    v, nums = F.col("value_num"), numbers_in(F.col("quote"))
    result = F.when(v.isNull() | (F.col("value_type") == "bool") | F.col("quote").isNull(), "n/a").when(F.exists(nums, lambda n: close(n, v)), "pass").otherwise("warn")
    return claims.withColumn("numeric_result", result)


def trace(claims: DataFrame, texts: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """``trace_result`` and ``trace_reason`` of claims with ``span_id`` and ``quote_hash``, and the result of
    each check: the span resolves in ``texts`` (see ``documents.addressed``), its text has the recorded
    hash, the number claimed stands in it, and it entails the claim (``verdicts``: claim_id, entailed; a
    claim without one fails; no table: not checked). The first failure decides and those behind it are
    n/a; else any warning is one, with all reasons."""
    c = resolve_spans(claims, texts)
    entailed = F.lit(None).cast("boolean")
    if verdicts is not None:
        c = c.join(verdicts.groupBy("claim_id").agg(F.min("entailed").alias("_entailed")), "claim_id", "left")
        entailed = F.coalesce("_entailed", F.lit(False))
    resolved, v = F.col("span_text").isNotNull(), F.col("value_num")
    same = quote_hash(F.col("span_text")) == F.col("quote_hash")
    numeric = F.when(v.isNull() | (F.col("value_type") == "bool"), "n/a").when(F.exists(numbers_in(F.col("span_text")), lambda n: close(n, v)), "pass").otherwise("warn")
    c = c.withColumn("span_result", F.when(resolved, "pass").otherwise("fail")).withColumn("hash_result", F.when(~resolved, "n/a").when(F.coalesce(same, F.lit(False)), "pass").otherwise("fail"))
    whole = F.col("hash_result") == "pass"
    c = c.withColumn("numeric_result", F.when(whole, numeric).otherwise("n/a")).withColumn("entailment_result", F.when(~whole | entailed.isNull(), "n/a").when(entailed, "pass").otherwise("fail"))
    failed = F.when(F.col("span_result") == "fail", "span does not resolve").when(F.col("hash_result") == "fail", "text at span differs from recorded hash").when(F.col("entailment_result") == "fail", "not entailed")
    warned = F.when(F.col("numeric_result") == "warn", "number not in span")
    result = F.when(failed.isNotNull(), "fail").when(warned.isNotNull(), "warn").otherwise("pass")
    return c.withColumns({"trace_result": result, "trace_reason": F.coalesce(failed, warned)}).drop("_entailed")


def symbol_check(formulas: DataFrame) -> DataFrame:
    """``symbol_check`` of formulas with ``symbols`` and ``undefined``, arrays of names."""
    return formulas.withColumn("symbol_check", symbol_result(F.col("symbols"), F.col("undefined")))


def valid_claims(claims: DataFrame) -> DataFrame:
    """``(claim_id, path, error)``: what is wrong with claims by their schema, in order of the path; none
    for a valid one. The schema is a set of conditions, so any number of them is one pass."""
    kind = F.col("type")
    checks = [
        ("applies_to", kind.isin("hyperparameter", "method") & F.col("applies_to").isNull(), "required"),
        ("canonical_name", F.col("canonical_name").isNull(), "required"),
        ("canonical_name", (kind == "hyperparameter") & ~F.coalesce(F.col("canonical_name").rlike(r"^[a-z][a-z0-9_]*$"), F.lit(True)), "pattern"),
        ("confidence", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "range"),
        ("stated_explicitly", F.col("stated_explicitly").isNull(), "required"),
        ("status", ~F.coalesce(F.col("status").isin("extracted", "verified", "rejected", "superseded"), F.lit(False)), "enum"),
        ("value", F.col("value").isNull(), "required"),
        ("value", (kind == "result") & F.col("value").isNotNull() & F.col("value_num").isNull(), "number"),
        ("value_type", (kind == "hyperparameter") & ~F.coalesce(F.col("value_type").isin("float", "int", "bool", "categorical"), F.lit(False)), "enum"),
    ]
    found = F.filter(F.array(*(F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(error).alias("error"))) for path, bad, error in checks)), lambda x: x.isNotNull())
    return claims.select("claim_id", F.inline(found))


def typed_values(claims: DataFrame) -> DataFrame:
    """``value_type`` as the value has it: numbers written as text are numbers, a fraction is no int, and
    what declares no known type gets the one it looks like."""
    v = F.trim("value")
    number = F.replace(F.replace(v, F.lit(","), F.lit("")), F.lit("−"), F.lit("-"))
    is_number, is_bool = number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.lower(v).isin("true", "false")
    whole = number.rlike(r"^[+-]?[0-9]+$")
    looks = F.when(is_bool, "bool").when(whole, "int").when(is_number, "float").otherwise("categorical")
    declared = F.col("value_type")
    known = declared.isin("float", "int", "bool", "categorical")
    kind = F.when(~F.coalesce(known, F.lit(False)) | is_bool, looks).when((declared == "int") & is_number & ~whole, "float").otherwise(declared)
    recovered = F.when(declared.isin("float", "int") & is_number, number).otherwise(v)
    return claims.withColumns({"value_type": kind, "value": recovered})


def confidence_of(fidelity: Column) -> Column:
    """How far a text is trusted by how its formulas were read."""
    rate = F.lit(OTHER_CONFIDENCE)
    for how, value in FIDELITY_CONFIDENCE.items():
        rate = F.when(fidelity == how, value).otherwise(rate)
    return rate


def cited(claims: DataFrame, references: DataFrame) -> DataFrame:
    """``(claim_id, ref_key, arxiv_id)``: the first citation in a claim's quote that is a key of its paper's
    references, or looks like one; claims that cite nothing have no row."""
    keys = F.regexp_extract_all("quote", F.lit(r"\[([A-Za-z][A-Za-z0-9_:.-]{2,})\]"), 1)
    each = claims.select("claim_id", "paper_id", F.posexplode(keys).alias("at", "ref_key"))
    refs = references.groupBy("paper_id", "ref_key").agg(F.min("arxiv_id").alias("arxiv_id"), F.lit(True).alias("known"))
    met = each.join(refs, ["paper_id", "ref_key"], "left")
    looks = F.col("ref_key").rlike(r"\d") & ~F.col("ref_key").rlike(r"^[A-Z0-9_:.-]+$")
    first = met.where(F.col("known") | looks).groupBy("claim_id").agg(F.min_by(F.struct("ref_key", "arxiv_id"), "at").alias("c"))
    return first.select("claim_id", "c.ref_key", "c.arxiv_id")


def symbol_result(symbols: Column, undefined: Column) -> Column:
    """Formulas must define what they use: fail without symbols or with undefined ones."""
    return F.when(F.coalesce(F.size(symbols), F.lit(0)) <= 0, "fail").when(F.coalesce(F.size(undefined), F.lit(0)) <= 0, "pass").otherwise("fail")


def scope_findings(claims: DataFrame) -> DataFrame:
    """Scopes in which several unknown numeric quantities are described: they are listed, not judged."""
    odd = claims.where((F.col("type") == "hyperparameter") & F.col("status").isin("verified", "extracted") & ~F.col("name_key").isin(KNOWN_SETTINGS) & F.col("value_num").isNotNull())
    per = odd.groupBy("scope_id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_distinct("name_key").alias("n_names"))
    return per.where("n_claims >= 2 and n_names >= 2")


def verify(claims: DataFrame) -> DataFrame:
    """One verdict a claim from its trace, range and symbol results, in this order; claims of low
    confidence stay extracted; a number missing from the quote costs confidence and the claim counts
    as not stated."""
    trace, rng, sym = F.col("trace_result"), F.col("range_result"), F.col("symbol_result")
    reason = F.when(trace == "fail", "citation_trace").when(rng == "fail", "range_check").when(sym == "fail", "symbol_check")
    status = F.when(reason.isNotNull(), "rejected").when(F.col("confidence") < CONFIDENT, "extracted").otherwise("verified")
    weak = (F.col("new_status") == "verified") & (F.col("numeric_result") == "warn")
    out = claims.withColumns({"failed_check": reason, "new_status": status})
    return out.withColumns({"new_confidence": F.when(weak, F.bround(F.col("confidence") * WARNED, 4)).otherwise(F.col("confidence")), "new_explicit": F.when(weak, False).otherwise(F.col("stated_explicitly"))})


def verification_report(verified: DataFrame) -> DataFrame:
    """Counts by paper, with the reasons of rejections."""
    n = lambda c: F.count_if(c)
    rejected = n(F.col("new_status") == "rejected")
    return verified.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("total"), n(F.col("new_status") == "verified").alias("n_verified"), rejected.alias("n_rejected"), n(F.col("new_status") == "extracted").alias("low_confidence"),
        n((F.col("range_result") == "warn") | (F.col("numeric_result") == "warn")).alias("warned"), n(F.col("failed_check") == "citation_trace").alias("by_trace"), n(F.col("failed_check") == "range_check").alias("by_range"), (rejected / F.count(F.lit(1))).alias("rejection_rate"),
    )


def judged(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims with a judge's verdict; a claim without one counts as not entailed."""
    v = verdicts.groupBy("claim_id").agg(F.min("entailed").alias("verdict"))
    return claims.join(v, "claim_id", "left").withColumn("entailed", F.coalesce("verdict", F.lit(False))).drop("verdict")


def ranked_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
