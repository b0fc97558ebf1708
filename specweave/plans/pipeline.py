"""The whole run over stage tables: each stage written once, resumed by what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.operators import align, claims, conflicts, gaps, policy, rules, synthesis
from specweave.plans.queries import claim_view
from specweave.session import cut, table
from specweave.sources.store import RunStore, fingerprint


#: What the stages go by beside the tables: a run that was made by other values is not resumed.
SETTINGS = {"version": 2, "range_rules": rules.RANGES, "spellings": rules.SPELLINGS, "policy": rules.POLICY, "checklist": rules.CHECKLIST, "confident": claims.CONFIDENT}


def run(spark: SparkSession, sf_dir: str, out: str, resume: bool = True, texts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Stages from the claims of ``sf_dir`` to a specification under ``out``.

    A blocking conflict without decision leaves a draft only. Stages are resumed only if the run's
    fingerprint (settings, papers) is that of the tables. With ``texts`` (see ``documents.addressed``)
    every claim's span and quote are traced anew; without, the recorded trace is taken."""
    store = RunStore(spark, out)
    papers = table(spark, sf_dir, "papers")
    if "sha256" not in papers.columns:
        papers = papers.withColumn("sha256", F.lit(None).cast("string"))
    made_by = fingerprint(SETTINGS | {"data": sf_dir, "traced": texts is not None}, papers)
    resume = resume and store.facts().get("fingerprint") in (None, made_by)
    papers = papers.select("paper_id", "title", "venue", "year")
    s: dict[str, DataFrame] = {}
    s["claims"] = store.stage("01_claims", lambda: claim_view(spark, sf_dir), resume)
    traced = s["claims"] if texts is None else claims.trace(s["claims"], texts).drop("span_text", "span_result", "hash_result", "entailment_result", "trace_reason", "numeric_result")
    s["checked"] = store.stage("02_checked", lambda: claims.verify(claims.numeric_check(claims.range_check(traced))), resume)
    s["verified"] = verdicts(s["checked"])
    s["clusters"] = store.stage("03_clusters", lambda: align.blocks(s["verified"]), resume)
    s["conflicts"] = store.stage("04_conflicts", lambda: conflicts.all_conflicts(s["verified"]), resume)
    s["resolutions"] = with_decisions(store, store.stage("05_resolutions", lambda: resolutions(s["conflicts"], papers), resume))
    s["gaps"] = store.stage("06_gaps", lambda: gaps.gaps(s["verified"]), resume)
    return s | synthesize(spark, store, s, papers, made_by)


def with_decisions(store: RunStore, decided: DataFrame) -> DataFrame:
    """Resolutions with the decisions that people took, the latest of each conflict. Decisions are a table of
    their own that is only ever added to, so no crash and no later run loses one."""
    if not store.has("decisions"):
        return decided
    d = store.read("decisions").groupBy("contradiction_id").agg(F.max_by("selected_claim_id", "taken_at").alias("selected_claim_id"))
    return policy.decided(decided, d.join(decided.select("contradiction_id"), "contradiction_id", "left_semi"))


def verdicts(checked: DataFrame) -> DataFrame:
    """Claims as the checks leave them, whatever status they came with: all later stages take these."""
    new = {"status": F.col("new_status"), "confidence": F.col("new_confidence"), "stated_explicitly": F.col("new_explicit")}
    return checked.withColumns(new).drop("new_status", "new_confidence", "new_explicit")


def resolutions(found: DataFrame, papers: DataFrame) -> DataFrame:
    pos = conflicts.positions_with_support(found, papers).withColumn("is_primary", F.lit(False))
    fields = F.struct("claim_id", "paper_id", "position", "specificity", "stated_explicitly", "has_condition", "is_primary", "year", "peer_reviewed")
    packed = pos.groupBy("contradiction_id", "conflict_type", "severity").agg(F.array_sort(F.collect_list(fields)).alias("positions"))
    return policy.resolve(packed).select("contradiction_id", "severity", "rule_fired", "outcome", "selected_claim_id").withColumn("resolved_by", F.lit("policy"))


def synthesize(spark: SparkSession, store: RunStore, s: dict[str, DataFrame], papers: DataFrame, made_by: str) -> dict[str, DataFrame]:
    """The last stage, also after a human's decision: no earlier stage is run again."""
    r = s["resolutions"]
    lost = synthesis.superseded(s["verified"], r)
    disputed = synthesis.disputed_scopes(s["conflicts"], r)
    values = store.write("07_values", synthesis.components(s["verified"], disputed, lost))
    links = store.write("07_links", synthesis.component_links(s["verified"], disputed, lost))
    results = store.write("07_results", synthesis.expected_results(s["verified"], disputed, lost))
    decisions = store.write("07_decisions", synthesis.design_decisions(s["verified"]))
    state = synthesis.split_conflicts(s["conflicts"], r)
    gate = synthesis.blocking(s["conflicts"], r)
    closure = synthesis.provenance_closure(links, s["verified"])
    errors = claims.valid_claims(s["verified"].where("status = 'verified'"))
    open_ = r.where("outcome in ('ESCALATED', 'DEFERRED')")
    still = s["conflicts"].join(open_, "contradiction_id", "left_semi").select("contradiction_id", "conflict_type", "severity", "name_key", "cond")
    listed = conflicts.described(state.where("state = 'open'")).select("contradiction_id", "conflict_type", "severity", "name_key", "cond", "description")
    doc = synthesis.spec_document("spec", values, results, listed, s["gaps"], synthesis.contributing_papers(papers, s["verified"]))
    draft = not gate.isEmpty()
    name = store.spec(doc, draft)
    problem = synthesis.first_problem(gate, closure, spark.createDataFrame([], "node string"), errors)
    store.manifest(draft=draft, spec=name, fingerprint=made_by, first_problem=problem)
    return {"values": values, "links": links, "results": results, "decisions": decisions, "blocking": gate, "open_conflicts": still, "closure": closure, "errors": errors}


def decide(spark: SparkSession, sf_dir: str, out: str, contradiction_id: str, claim_id: str) -> bool:
    """A human's decision on one conflict; False if the claim is none of its positions."""
    store = RunStore(spark, out)
    s = {k: store.read(t) for k, t in (("checked", "02_checked"), ("conflicts", "04_conflicts"), ("gaps", "06_gaps"))}
    s["verified"] = verdicts(s["checked"])
    position = F.exists("positions", lambda p: p["claim_id"] == claim_id)
    if s["conflicts"].where((F.col("contradiction_id") == contradiction_id) & position).isEmpty():
        return False
    row = spark.createDataFrame([(contradiction_id, claim_id)], "contradiction_id string, selected_claim_id string")
    row.withColumn("taken_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{store.path}/decisions")
    # The table of decisions holds them all, so this stage may be written anew at any time; aside first,
    # as it is read while its successor is computed.
    s["resolutions"] = store.write("05_resolutions", cut(with_decisions(store, store.read("05_resolutions")), "decided"))
    synthesize(spark, store, s, table(spark, sf_dir, "papers", "paper_id", "title", "venue", "year"), store.facts().get("fingerprint", ""))
    return True


def review_document(spark: SparkSession, out: str) -> str:
    """A run as text for a reader: what blocks, what is open, what is missing. Counts are exact; of the
    lists, which a reader goes through, the gravest hundred are shown."""
    store, most = RunStore(spark, out), 100
    c = synthesis.split_conflicts(store.read("04_conflicts"), with_decisions(store, store.read("05_resolutions")))
    gaps_, values = store.read("06_gaps"), store.read("07_values")
    lines = [f"# Review of {out}", "", f"Values: {values.count()}", ""]
    counts = {r["state"]: r["count"] for r in c.groupBy("state").count().collect()}
    for state, title in (("blocking", "Blocking conflicts"), ("open", "Open conflicts"), ("resolved", "Decided conflicts")):
        lines += [f"## {title}: {counts.get(state, 0)}", ""]
        lines += [f"- {r['contradiction_id']} ({r['severity']}): {r['description']}" for r in conflicts.ranked(conflicts.described(c.where(F.col("state") == state))).limit(most).collect()] + [""]
    lines += [f"## Missing: {gaps_.count()}", ""] + [f"- {r['criticality']}: {r['n_gaps']}" for r in gaps.gap_summary(gaps_).orderBy("criticality").collect()]
    return "\n".join(lines) + "\n"
