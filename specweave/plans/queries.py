"""Queries of the core operators over the test tables, whole tables each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.functions import ids, text
from specweave.operators import align, claims, conflicts, documents, gaps, operations, policy, synthesis
from specweave.operators.rules import SECTION_PATTERNS
from specweave.operators.snapshots import change_summary, resolution_changes, snapshot_changes
from specweave.operators.units import convert_units, mixed_amounts
from specweave.session import cut, table
from specweave.sources import latex, pages
from specweave.streaming.ledger import daily_usage, sessions

Query = Callable[[SparkSession, str], DataFrame]


def claim_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims as the operators take them: once each, typed, with plain names and flat provenance."""
    c = claims.once(table(spark, sf_dir, "claims"))
    own = c.schema["provenance"].dataType.names
    part = lambda name, kind: (F.col(f"provenance.{name}") if name in own else F.lit(None).cast(kind)).alias(name)
    flat = c.select("claim_id", "paper_id", "type", "status", "canonical_name", "paper_symbol", "value", "value_type", "unit", "applies_to", "condition", "stated_explicitly", "quote", "confidence", F.col("provenance.span_id").alias("span_id"), F.col("provenance.scope_id").alias("scope_id"), F.col("provenance.section").alias("section"), part("char_end", "int"), part("quote_hash", "string"), F.col("verification.citation_trace").alias("trace_result"), F.col("verification.symbol_check").alias("symbol_result"))
    return claims.typed(claims.canonical_names(flat))


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claim view as a stage table, where a query reads it more than once."""
    return cut(claim_view(spark, sf_dir), "claims")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "paper_id", "section", "text")


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.value_conflicts(claim_view(spark, sf_dir))


def _positions(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    return conflicts.positions_with_support(_conflicts(spark, sf_dir) if found is None else found, table(spark, sf_dir, "papers", "paper_id", "venue", "year"))


def _resolved(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Conflicts with supported positions, resolved by the rule table."""
    pos = _positions(spark, sf_dir, found).withColumn("is_primary", F.lit(False))
    fields = F.struct("claim_id", "paper_id", "position", "specificity", "stated_explicitly", "has_condition", "is_primary", "year", "peer_reviewed")
    packed = pos.groupBy("contradiction_id", "conflict_type", "severity").agg(F.array_sort(F.collect_list(fields)).alias("positions"))
    return policy.resolve(packed)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger: the type is the provider, the value the tokens; errors failed."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", "ts", F.col("event_type").alias("provider"), F.col("user_id"), F.col("value").alias("tokens"), (F.col("event_type") == "error").alias("failed"), (k % 4 == 0).alias("cached"), k.alias("prompt_hash"))


# One function a query -------------------------------------------------------------------------


def p2_found(spark, d):
    return mixed_amounts(table(spark, d, "claims"), table(spark, d, "common_units"))


def p2_amounts(spark, d):
    return convert_units(table(spark, d, "claims"), table(spark, d, "common_units"))


def p5_found(spark, d):
    return snapshot_changes(*(table(spark, d, t) for t in ("spec_values", "spec_conflicts", "spec_gaps")))


def quote_hash_dups(spark, d):
    return documents.same_texts(_documents(spark, d))


def normalized_texts(spark, d):
    n = text.normalize_text(F.col("text"))
    return _documents(spark, d).where("text is not null").select("doc_id", F.sha2(n, 256).alias("digest"), F.length(n).alias("n_chars"))


def paragraph_spans(spark, d):
    return documents.spans(_documents(spark, d))


def slugs(spark, d):
    return table(spark, d, "papers", "paper_id", ids.slugify(F.col("title")).alias("slug"), ids.component_id(F.col("venue")).alias("component_id"))


def span_parts(spark, d):
    p = ids.parse_span(F.col("provenance.span_id"))
    c = table(spark, d, "claims", "claim_id", p.alias("p"), ids.scope_id(F.col("provenance.span_id")).alias("scope_id"), F.col("provenance.scope_id").alias("given"))
    return c.select("claim_id", "p.section", "p.paragraph", F.col("p.offset").alias("char_offset"), "scope_id", (F.col("scope_id") == F.col("given")).alias("round_trip")).distinct()


def content_ids(spark, d):
    c = claim_view(spark, d)
    return c.select("claim_id", ids.content_id("clm", F.col("paper_id"), F.col("type"), F.col("span_id"), F.col("value")).alias("content_id"), ids.cluster_id(F.col("type"), F.col("name_key")).alias("cluster_id"))


def claims_once(spark, d):
    return claims.once(table(spark, d, "claims", "claim_id", "paper_id", "type", "status", "value", "confidence", "loaded_at"))


def numeric_literals(spark, d):
    nums = text.numbers_in(F.col("quote"))
    return claim_view(spark, d).where("quote is not null").select("claim_id", F.size(nums).alias("n_numbers"), F.coalesce(F.array_max(nums), F.lit(0.0)).alias("largest"))


def citation_keys(spark, d):
    return _documents(spark, d).select("doc_id", F.explode(text.citation_keys(F.col("text"))).alias("ref_key")).groupBy("doc_id", "ref_key").agg(F.count(F.lit(1)).alias("n"))


def find_span(spark, d):
    items = table(spark, d, "eval_items", "item_id", F.col("text").alias("needle")).withColumn("scope", F.lit("all"))
    docs = _documents(spark, d).select("doc_id", "text", F.lit("all").alias("scope"))
    return documents.find_spans(items, docs, "scope", "item_id", "doc_id")


def latex_sections(spark, d):
    tex = _documents(spark, d).where(F.col("text").rlike(latex.SECTIONED))
    found = latex.sections(tex.select(F.col("doc_id").alias("paper_id"), F.col("text").alias("source")))
    return found.withColumnRenamed("paper_id", "doc_id").orderBy("doc_id", "section_index")


def latex_equations(spark, d):
    e = latex.equations(_documents(spark, d), "doc_id", F.col("text"))
    return e.select("doc_id", "equation_index", "latex")


def formula_quality(spark, d):
    e = latex.equations(_documents(spark, d), "doc_id", F.col("text"))
    return e.select("doc_id", "equation_index", F.coalesce(text.formula_quality(F.col("latex")), F.lit("fine")).alias("quality"))


def reference_entries(spark, d):
    return documents.references(_documents(spark, d))


def _sources(spark, d):
    """Every document as LaTeX with its section as title, its year as date, and references to other papers."""
    docs = table(spark, d, "documents", "doc_id", "section", "year", "text")
    made = F.concat(F.lit("\\title{On \\emph{"), "section", F.lit("}} % not \\title{this}\n\\date{May "), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("}\n\\begin{document}\\begin{abstract} We study "), "section", F.lit(". \\end{abstract}\n\\section{One} A \\textbf{bold} claim \\cite{a,b}.\n\\begin{algorithm}\\caption{Steps of "), "section", F.lit("}\\label{alg:x} do it \\end{algorithm}\\[ x = 1 \\]\n\\begin{thebibliography}{9}\\bibitem{k"), F.col("doc_id").cast("string"), F.lit("} Some work, arXiv:1409.0473, 2014.\\bibitem[B]{other} Old, 1999.\\end{thebibliography}\\end{document}"))
    return docs.select(F.col("doc_id").alias("paper_id"), made.alias("source"))


def latex_algorithms(spark, d):
    return latex.algorithms(_sources(spark, d), "paper_id", "source")


def front_matter(spark, d):
    return latex.front_matter(_sources(spark, d))


def bibliography(spark, d):
    return latex.bibliography(_sources(spark, d))


def plain_sections(spark, d):
    p = latex.plain_sections(latex.sections(_sources(spark, d)))
    return p.select("paper_id", "section_index", "title", F.regexp_replace("body", r"^\s+|\s+$", "").alias("body"))


def page_paragraphs(spark, d):
    """Documents whose blank lines in pairs end a page."""
    paged = _documents(spark, d).select("doc_id", F.replace("text", F.lit("\n\n"), F.lit("\f")).alias("text"))
    return pages.page_paragraphs(paged).select("doc_id", "page", "paragraph", F.length("text").alias("n_chars"))


def readers(spark, d):
    ref = F.concat("paper_id", F.when(F.col("ingest_method") == "pdf", F.lit(".pdf")).when(F.col("ingest_method") == "latex", F.lit("/")).otherwise(F.lit("")))
    return table(spark, d, "papers", "paper_id", pages.reader_of(ref).alias("reader"))


def reviewed_formulas(spark, d):
    e = latex.equations(_documents(spark, d), "doc_id", "text").withColumn("fidelity", F.when(F.col("doc_id") % 2 == 0, "text_layer").otherwise("latex_native"))
    r = pages.review_formulas(e.withColumn("key", F.concat_ws("/", "doc_id", "equation_index")))
    return pages.document_fidelity(r)


def suspect_math_lines(spark, d):
    return documents.suspect_math_lines(_documents(spark, d))


def section_triage(spark, d):
    docs = _documents(spark, d)
    return reduce(DataFrame.unionByName, (documents.triage(docs, kind) for kind in SECTION_PATTERNS))


def batch_packing(spark, d):
    return documents.pack(_documents(spark, d))


def read_candidates(spark, d):
    return claims.read_candidates(table(spark, d, "claim_candidates")).select("record_id", F.col("reply").isNotNull().alias("readable"), "canonical_name", "value_type")


def admitted(spark, d):
    return claims.admit(table(spark, d, "claim_candidates")).groupBy(F.coalesce("reject_reason", F.lit("admitted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def extraction_confidence(spark, d):
    return table(spark, d, "papers", "paper_id", claims.confidence_of(F.col("math_fidelity")).alias("confidence"))


def citation_trace(spark, d):
    """Claims traced in the paragraphs that their spans name."""
    traced = claims.trace(claim_view(spark, d), documents.addressed(_documents(spark, d)))
    return traced.select("claim_id", "span_result", "hash_result", "numeric_result", "trace_result", "trace_reason")


def quote_trace(spark, d):
    """Every paragraph as a claim that quotes it: half of the hashes are those of the whole paragraph, the
    others end where the span does, so both outcomes and numbers of all kinds are met."""
    texts = documents.addressed(_documents(spark, d))
    n, whole = F.length("text"), F.col("paragraph") % 2 == 0
    sid = ids.span_id(F.col("paper_id"), F.col("section_index"), F.col("paragraph"), F.lit(3))
    quoted = texts.select(F.concat_ws("/", "doc_id", "paragraph").alias("claim_id"), "paper_id", sid.alias("span_id"), F.when(whole, n).otherwise(n - 4).alias("char_end"), ids.quote_hash(F.substring(F.col("text"), F.lit(4), n)).alias("quote_hash"), (F.col("paragraph") + F.lit(0.0)).alias("value_num"), F.lit("int").alias("value_type"))
    return claims.trace(quoted, texts).select("claim_id", "span_result", "hash_result", "numeric_result", "trace_result")


def claim_schema(spark, d):
    return claims.valid_claims(claim_view(spark, d))


def typed_values(spark, d):
    t = claims.typed_values(claims.once(table(spark, d, "claims", "claim_id", "value", "value_type", "loaded_at")))
    return t.select("claim_id", "value_type", "value")


def cited_references(spark, d):
    """For each document the first citation in it that its paper's documents give as a key, or that looks
    like one."""
    docs = _documents(spark, d)
    refs = docs.select("paper_id", F.explode(text.citation_keys(F.col("text"))).alias("ref_key"), F.lit(None).cast("string").alias("arxiv_id"))
    return claims.cited(docs.select(F.col("doc_id").alias("claim_id"), "paper_id", F.col("text").alias("quote")), refs).select("claim_id", "ref_key")


def anchored(spark, d):
    """Why candidates are admitted or not, with their quotes looked for in their papers' documents."""
    a = claims.admit(table(spark, d, "claim_candidates"), _documents(spark, d))
    return a.groupBy(F.coalesce("reject_reason", F.lit("admitted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def canonicalized_names(spark, d):
    return claim_view(spark, d).groupBy("name_key").agg(F.count(F.lit(1)).alias("n_claims"), F.count_distinct("canonical_name").alias("n_spellings"))


def range_check(spark, d):
    return claims.range_check(claim_view(spark, d)).select("claim_id", "range_result")


def numeric_literal_check(spark, d):
    return claims.numeric_check(claim_view(spark, d)).select("claim_id", "numeric_result")


def internal_consistency(spark, d):
    return claims.scope_findings(claim_view(spark, d))


def _verified(spark, d):
    return claims.verify(claims.numeric_check(claims.range_check(claim_view(spark, d))))


def verify_status(spark, d):
    return _verified(spark, d).select("claim_id", "new_status", "failed_check", F.round("new_confidence", 3).alias("new_confidence"))


def verification_report(spark, d):
    return claims.verification_report(_verified(spark, d)).withColumn("rejection_rate", F.round("rejection_rate", 6))


def self_consistency_vote(spark, d):
    c = claim_view(spark, d).withColumn("pass", F.instr(F.lit("0123456789abcdef"), F.substring("claim_id", -1, 1)) % 3)
    return claims.vote(c, 3).select("paper_id", "type", "name_key", "value_key", "claim_id", "self_consistency")


def judged_claims(spark, d):
    verdicts = table(spark, d, "claims", "claim_id", (F.col("verification.citation_trace") == "pass").alias("entailed")).where("entailed")
    return claims.judged(claim_view(spark, d), verdicts).groupBy("type").agg(F.count_if("entailed").alias("entailed"), F.count_if(~F.col("entailed")).alias("not_entailed"))


def alignment_blocks(spark, d):
    return align.blocks(_staged(spark, d))


def usual_names(spark, d):
    return align.usual_name(claim_view(spark, d), ["name_key"], "canonical_name")


def symbol_map(spark, d):
    return align.symbol_map(claim_view(spark, d))


def merge_candidates(spark, d):
    return align.merge_candidates(claim_view(spark, d), None)


def merge_candidates_shown(spark, d):
    return align.merge_candidates(claim_view(spark, d))


def _merges(view):
    """Keys of one type and first letter, proposed to be one."""
    candidates = align.merge_candidates(view, None)
    return align.valid_merges(candidates.select("type", F.ascii("name_key").alias("proposal"), "name_key"), candidates)


def valid_merges(spark, d):
    return _merges(_staged(spark, d))


def merged_keys(spark, d):
    view = _staged(spark, d)
    return align.merged_keys(view, _merges(view))


def cluster_members(spark, d):
    m = align.cluster_members(claim_view(spark, d))
    return m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_distinct("paper_id").alias("n_papers"), F.count_distinct("symbol").alias("n_symbols"))


def remerged_clusters(spark, d):
    """Clusters split by what their claims apply to, with children of one value put together again."""
    view = cut(claim_view(spark, d).where("status = 'verified'").withColumn("cluster_id", ids.cluster_id(F.col("type"), F.col("name_key"))), "members")
    split = align.split_clusters(view.select("cluster_id", "claim_id"), view.select("cluster_id", "claim_id", F.col("applies_to").alias("label")).where("label <> 'global'"))
    return align.merge_identical(split, view).groupBy("cluster_id").agg(F.count_distinct("child_id").alias("n_children"), F.count(F.lit(1)).alias("n_claims"))


def single_paper_keys(spark, d):
    return align.single_paper_keys(claim_view(spark, d))


def paper_components(spark, d):
    """Papers linked by a symbol they share with the first paper that uses it for the same name."""
    keys = ["symbol", "name_key"]
    c = claim_view(spark, d).where("status = 'verified' and trim(paper_symbol) <> ''").select("paper_id", F.trim("paper_symbol").alias("symbol"), "name_key").distinct()
    first = c.groupBy(*keys).agg(F.min("paper_id").alias("hub"))
    return align.connected_components(c.join(first, keys).select(F.col("paper_id").alias("a"), F.col("hub").alias("b")))


def cluster_split(spark, d):
    c = cut(claim_view(spark, d).where("status = 'verified'").select(ids.cluster_id(F.col("type"), F.col("name_key")).alias("cluster_id"), "claim_id", F.col("applies_to").alias("label")), "members")
    labels = c.where("label <> 'global'")
    return align.split_clusters(c.select("cluster_id", "claim_id"), labels).groupBy("cluster_id").agg(F.count_distinct("child_id").alias("n_children"), F.count(F.lit(1)).alias("n_claims"))


def value_conflict(spark, d):
    return _conflicts(spark, d).select("contradiction_id", "cluster_id", "severity", "name_key", "cond", "unit_key", "n_values")


def value_conflict_severity(spark, d):
    return _conflicts(spark, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def result_conflict(spark, d):
    return conflicts.result_conflicts(claim_view(spark, d)).drop("positions")


def method_conflict(spark, d):
    return conflicts.method_conflicts(claim_view(spark, d)).drop("positions")


def definition_conflict(spark, d):
    return conflicts.definition_conflicts(claim_view(spark, d)).drop("positions")


def conflict_scan(spark, d):
    """Conflicts of all kinds, the gravest first."""
    found = conflicts.all_conflicts(_staged(spark, d))
    return conflicts.ranked(found.select("contradiction_id", "conflict_type", "severity", "name_key", "n_values"))


def conflict_descriptions(spark, d):
    return conflicts.described(_conflicts(spark, d)).select("contradiction_id", "description")


def near_approaches(spark, d):
    """Pairs of approaches to one design question that are nearly identical."""
    v = claim_view(spark, d).where("type = 'method' and trim(value) <> ''").select("name_key", F.lower(F.trim(F.regexp_replace("value", r"\s+", " "))).alias("approach")).distinct()
    return conflicts.similar_texts(v, ["name_key"], "approach", F.array("approach"), conflicts.APPROACH_CUT)


def specificity(spark, d):
    return claim_view(spark, d).select("claim_id", conflicts.specificity(F.col("condition"), F.col("applies_to"), F.col("stated_explicitly")).alias("specificity"))


def paper_support(spark, d):
    return _positions(spark, d).select("contradiction_id", "claim_id", "paper_id", "position", "venue", "year", "peer_reviewed")


def policy_resolve(spark, d):
    return _resolved(spark, d).select("contradiction_id", "severity", "rule_fired", "outcome", "selected_claim_id")


def policy_by_rule(spark, d):
    return _resolved(spark, d).groupBy(F.coalesce("rule_fired", F.lit("none")).alias("rule"), "outcome").agg(F.count(F.lit(1)).alias("n"))


def human_upsert(spark, d):
    r = cut(_resolved(spark, d), "resolutions")
    decisions = r.where("severity = 'BLOCKING'").select("contradiction_id", F.array_min(F.transform("positions", lambda p: p["claim_id"])).alias("selected_claim_id"))
    return policy.decided(r, decisions)


def gap_checklist(spark, d):
    return gaps.gaps(_staged(spark, d))


def gap_summary(spark, d):
    return gaps.gap_summary(gaps.gaps(_staged(spark, d)))


def gap_ablation(spark, d):
    return gaps.ablation(_staged(spark, d))


def stripped_questions(spark, d):
    return table(spark, d, "spec_gaps", "gap_id", text.strip_suggestion(F.concat("question", F.lit(" We suggest a default. It is open."))).alias("question")).distinct()


def _fields(spark, d):
    return table(spark, d, "spec_gaps", "spec_id", "field", "snapshot_no", "question", "criticality", "gap_id")


def matching_fields(spark, d):
    """Open fields of a spec and names of its values that mean one thing."""
    names = table(spark, d, "spec_values", "spec_id", F.col("canonical_name").alias("field"))
    return gaps.matching_fields(_fields(spark, d), names, "spec_id")


def proposed_gaps(spark, d):
    """Gaps of a spec's first snapshot, to which those of the later ones are proposed; what the spec has a
    value for is supplied, and what it has one by condition for is contested."""
    g = _fields(spark, d)
    first = g.groupBy("spec_id").agg(F.min("snapshot_no").alias("first"))
    g = cut(g.join(first, "spec_id"), "gaps")
    old = g.where("snapshot_no = first").groupBy("spec_id", "field").agg(F.min("gap_id").alias("gap_id"), F.min("question").alias("question"), F.min("criticality").alias("criticality"))
    new = g.where("snapshot_no > first").select("spec_id", F.col("snapshot_no").alias("rank"), "field", F.concat("question", F.lit(" Probably the default.")).alias("question"), "criticality")
    v = table(spark, d, "spec_values", "spec_id", F.col("canonical_name").alias("field"), "condition")
    scoped = F.coalesce("condition", F.lit("")) != ""
    return gaps.add_proposed(old, new, v.where(~scoped), v.where(scoped), "spec_id")


def merge_agreeing(spark, d):
    return synthesis.merge_agreeing(claim_view(spark, d))


def value_links(spark, d):
    return synthesis.value_links(claim_view(spark, d))


def design_decisions(spark, d):
    return synthesis.design_decisions(claim_view(spark, d))


def component_kinds(spark, d):
    view = _staged(spark, d)
    no_scope = spark.createDataFrame([], "type string, name_key string, cond string")
    values = synthesis.components(view, no_scope, view.select("claim_id").where("false"))
    return synthesis.component_kinds(values, synthesis.design_decisions(view))


def contribution(spark, d):
    return synthesis.contribution(table(spark, d, "papers", "paper_id"), claim_view(spark, d))


def contributing_papers(spark, d):
    return synthesis.contributing_papers(table(spark, d, "papers", "paper_id", "title"), claim_view(spark, d))


def verification_summary(spark, d):
    return synthesis.verification_summary(claims.verification_report(_verified(spark, d)))


def conflict_states(spark, d):
    view = _staged(spark, d)
    found = cut(conflicts.value_conflicts(view), "conflicts")
    return synthesis.split_conflicts(found, _resolved(spark, d, found).select("contradiction_id", "outcome")).groupBy("state", "severity").agg(F.count(F.lit(1)).alias("n"))


def superseded(spark, d):
    view = _staged(spark, d)
    r = _resolved(spark, d, conflicts.value_conflicts(view)).select("contradiction_id", "outcome", "selected_claim_id")
    return synthesis.superseded(view, r)


def spec_components(spark, d):
    view = _staged(spark, d)
    found = cut(conflicts.value_conflicts(view), "conflicts")
    r = cut(_resolved(spark, d, found).select("contradiction_id", "outcome", "selected_claim_id"), "resolutions")
    return synthesis.components(view, synthesis.disputed_scopes(found, r), synthesis.superseded(view, r)).select("component_id", "name_key", "cond", "value_key", "exemplar", "n_refs", "n_papers")


def expected_results(spark, d):
    return synthesis.expected_results(claim_view(spark, d))


def assumptions(spark, d):
    return synthesis.assumptions(claim_view(spark, d))


def provenance_closure(spark, d):
    """References to claims of every status, and to records that are no claims."""
    view = _staged(spark, d)
    links = synthesis.value_links(view.withColumn("status", F.lit("verified")))
    stray = table(spark, d, "merge_candidates", F.lit("val").alias("value_id"), F.col("candidate_id").alias("claim_id"))
    return synthesis.provenance_closure(links.unionByName(stray), view)


def dag_cycle(spark, d):
    """Nations as a graph: a link from one to each that it sells more lines to than it buys from, and a
    chain of all suppliers' nations into the regions, which no cycle holds."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    s, c = table(spark, d, "supplier", "s_suppkey", "s_nationkey"), table(spark, d, "customer", "c_custkey", "c_nationkey")
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    sold = cut(lines.groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n")), "sold")
    back = sold.select(F.col("s_nationkey").alias("c_nationkey"), F.col("c_nationkey").alias("s_nationkey"), F.col("n").alias("m"))
    links = sold.join(back, ["s_nationkey", "c_nationkey"], "left").where("s_nationkey <> c_nationkey and n > coalesce(m, 0)").select(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target"))
    regions = table(spark, d, "nation", F.col("n_nationkey").alias("source"), (F.col("n_regionkey") + 1000).alias("target"))
    return synthesis.cycle_members(links.unionByName(regions))


def blocking_gate(spark, d):
    found = cut(_conflicts(spark, d), "conflicts")
    return synthesis.blocking(found, _resolved(spark, d, found).select("contradiction_id", "outcome"))


def ledger_summary(spark, d):
    return operations.ledger_summary(_ledger(spark, d), "provider").withColumn("tokens", F.round("tokens", 2))


def quota_headroom(spark, d):
    limits = spark.createDataFrame([("view", 80), ("click", 60), ("error", 50)], "provider string, daily_limit int")
    return operations.quota_headroom(_ledger(spark, d), limits)


def provider_fallback(spark, d):
    ledger = _ledger(spark, d)
    legs = spark.createDataFrame([("main", 1, "view"), ("main", 2, "click"), ("main", 3, "signup")], "route string, leg int, provider string")
    limits = spark.createDataFrame([("view", 80), ("click", 60)], "provider string, daily_limit int")
    quota = operations.quota_headroom(ledger, limits).select("provider", "day", F.coalesce("exhausted", F.lit(False)).alias("exhausted"))
    requests = ledger.where("failed").select(F.col("event_id").alias("request_id"), F.to_date("ts").alias("day"), F.lit("main").alias("route"))
    return operations.first_eligible(requests, legs, quota)


def text_coverage(spark, d):
    docs = _documents(spark, d)
    hit = F.col("section").rlike("(?i)(result|experiment|setup)")
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    return operations.coverage(docs.select("paper_id", F.when(hit, n).otherwise(0).alias("read_chars"), n.alias("all_chars")), "paper_id")


def cache_misses(spark, d):
    ledger = _ledger(spark, d)
    return operations.cache_misses(ledger.where("not cached").select("prompt_hash"), ledger.where("cached").select("prompt_hash"))


def daily_ledger(spark, d):
    return daily_usage(table(spark, d, "events", "ts", "event_type", "value")).withColumn("amount", F.round("amount", 2))


def user_sessions(spark, d):
    s = sessions(table(spark, d, "events", "ts", "user_id"), gap="2 hours")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_events").alias("n_events"), F.max("n_events").alias("longest"))


def blocked_until(spark, d):
    e = _ledger(spark, d).withColumns({"refused": F.col("failed"), "retry_after": F.when(F.col("prompt_hash") % 2 == 0, F.col("prompt_hash"))})
    return operations.blocked_until(e.withColumn("ts", F.col("ts").cast("timestamp"))).select("provider", F.date_format("until", "yyyy-MM-dd HH:mm:ss").alias("until"))


def lost_batches(spark, d):
    docs = _documents(spark, d)
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    ok = F.col("text").isNotNull().cast("int")
    return operations.lost_batches(docs.select("paper_id", F.lit("all").alias("kind"), F.when(F.col("doc_id") % 3 > 0, n).otherwise(0).alias("read_chars"), n.alias("all_chars"), F.lit(1).alias("batches"), ok.alias("batches_ok")))


def snapshot_summary(spark, d):
    changes = snapshot_changes(*(table(spark, d, t) for t in ("spec_values", "spec_conflicts", "spec_gaps")))
    return change_summary(changes, resolution_changes(table(spark, d, "spec_values")))


def resolution_diff(spark, d):
    return resolution_changes(table(spark, d, "spec_values"))


def value_keys(spark, d):
    return claim_view(spark, d).groupBy("value_type").agg(F.count_distinct("value_key").alias("n_keys"), F.count("value_num").alias("n_numeric"))


QUERIES: list[Query] = [
    value_conflict, value_conflict_severity, result_conflict, method_conflict, definition_conflict, specificity, paper_support,
    quote_hash_dups, normalized_texts, paragraph_spans, slugs, span_parts, content_ids, claims_once, value_keys,
    numeric_literals, citation_keys, find_span, latex_sections, latex_equations, formula_quality, reference_entries, suspect_math_lines, section_triage, batch_packing,
    read_candidates, admitted, extraction_confidence, canonicalized_names, range_check, numeric_literal_check, internal_consistency, verify_status, verification_report, self_consistency_vote, judged_claims,
    alignment_blocks, usual_names, symbol_map, single_paper_keys, paper_components, cluster_split,
    policy_resolve, policy_by_rule, human_upsert, gap_checklist, gap_summary, gap_ablation, stripped_questions,
    merge_agreeing, superseded, spec_components, expected_results, assumptions, provenance_closure, dag_cycle, blocking_gate,
    ledger_summary, quota_headroom, provider_fallback, text_coverage, cache_misses, daily_ledger,
    citation_trace, quote_trace, claim_schema, typed_values, cited_references, anchored, merge_candidates, merge_candidates_shown, valid_merges, merged_keys, cluster_members, remerged_clusters,
    conflict_scan, conflict_descriptions, near_approaches, matching_fields, proposed_gaps, value_links, design_decisions, component_kinds, contribution, contributing_papers, verification_summary, conflict_states,
    latex_algorithms, front_matter, bibliography, plain_sections, page_paragraphs, readers, reviewed_formulas, user_sessions, blocked_until, lost_batches, snapshot_summary, resolution_diff,
    p2_found, p2_amounts, p5_found,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}
