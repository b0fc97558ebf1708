"""Queries do the whole job: small tables on which a part of it gives other results."""

import pandas as pd

from specweave.plans import pipeline, queries
from specweave.sources.store import RunStore


def folder(tmp_path, **tables):
    for name, rows in tables.items():
        pd.DataFrame(rows).to_parquet(tmp_path / f"{name}.parquet")
    return str(tmp_path)


def test_find_span_takes_the_whole_text(spark, tmp_path):
    opening = "These words stand at the start of more than one text and go on for over eighty characters"
    items = [("a", f"{opening} and then  the first\nending."), ("b", f"{opening}, but nothing holds this."), ("c", "short one"), ("d", None), ("e", " ")]
    texts = [opening, f"Before. {opening} and then the first ending. After.", f"{opening} and then the first ending.", "a short   one", None]
    docs = [(i, f"p{i}", "s", t) for i, t in enumerate(texts)]
    d = folder(tmp_path, eval_items=[dict(zip(("item_id", "text"), r)) for r in items], documents=[dict(zip(("doc_id", "paper_id", "section", "text"), r)) for r in docs])
    squeeze = lambda t: " ".join((t or "").split())
    want = []
    for i, needle in items:
        hits = [(doc, squeeze(t).index(squeeze(needle))) for doc, _, _, t in docs if squeeze(needle) and squeeze(needle) in squeeze(t)]
        want += [(i, *min(hits))] if hits else []
    assert want == [("a", 1, 8), ("c", 3, 2)]
    assert sorted(map(tuple, queries.find_span(spark, d).select("item_id", "doc_id", "at").collect())) == want


CLAIM = "claim_id string, paper_id string, type string, canonical_name string, value string, applies_to string, quote string, confidence double, status string, paper_symbol string, value_type string, unit string, condition string, stated_explicitly boolean, provenance struct<span_id string, scope_id string, section string>, verification struct<citation_trace string, symbol_check string>, loaded_at timestamp"


def claim_row(i, paper, kind, name, value, applies="global", quote=None, confidence=0.9, status="verified", symbol=None, cond=None):
    return (i, paper, kind, name, value, applies, quote, confidence, status, symbol, "float" if kind in ("hyperparameter", "result") else "categorical", None, cond, True, (f"{paper}#s1.p0.0", f"{paper}#s1", "S"), ("pass", "n/a"), None)


def claims_folder(spark, tmp_path, rows):
    d = folder(tmp_path, papers=[{"paper_id": p, "title": p, "venue": "ACL", "year": 2020} for p in "ab"])
    spark.createDataFrame(rows, CLAIM).write.parquet(f"{d}/claims.parquet")
    return d


def test_pipeline_scans_all_kinds_of_conflicts(spark, tmp_path):
    rows = [claim_row("h1", "a", "hyperparameter", "dropout", "0.1"), claim_row("h2", "b", "hyperparameter", "dropout", "0.10")]
    rows += [claim_row("m1", "a", "method", "tokenizer", "WordPiece"), claim_row("m2", "b", "method", "tokenizer", "SentencePiece")]
    rows += [claim_row("d1", "a", "definition", "misuse", "a call outside the set"), claim_row("d2", "b", "definition", "misuse", "any harm whatever")]
    rows += [claim_row("r1", "a", "result", "bleu", "27", "Base"), claim_row("r2", "b", "result", "bleu", "28", "base"), claim_row("r3", "a", "result", "bleu", "30", "large")]
    d, out = claims_folder(spark, tmp_path, rows), str(tmp_path / "run")
    s = pipeline.run(spark, d, out)
    found = {r["conflict_type"]: r for r in s["conflicts"].collect()}
    assert {k: (r["severity"], [p["claim_id"] for p in r["positions"]]) for k, r in found.items()} == {"METHOD_CONFLICT": ("BLOCKING", ["m1", "m2"]), "DEFINITION_CONFLICT": ("MATERIAL", ["d1", "d2"]), "RESULT_CONFLICT": ("MATERIAL", ["r1", "r2"])}
    assert {r["contradiction_id"] for r in s["resolutions"].collect()} == {r["contradiction_id"] for r in s["open_conflicts"].collect()} == {r["contradiction_id"] for r in found.values()}
    assert [r["conflict_type"] for r in s["blocking"].collect()] == ["METHOD_CONFLICT"] and (tmp_path / "run/spec.draft").exists() and not (tmp_path / "run/spec").exists()
    read = lambda: sorted(r["exemplar"] for t in ("07_values", "07_results") for r in RunStore(spark, out).read(t).collect())
    assert read() == ["h1", "r3"]
    assert pipeline.decide(spark, d, out, found["METHOD_CONFLICT"]["contradiction_id"], "m2") and (tmp_path / "run/spec").exists() and not (tmp_path / "run/spec.draft").exists()
    assert pipeline.decide(spark, d, out, found["RESULT_CONFLICT"]["contradiction_id"], "r2") and read() == ["h1", "r2", "r3"]


def test_pipeline_takes_what_the_checks_leave(spark, tmp_path):
    rows = [claim_row("h1", "a", "hyperparameter", "dropout", "0.1", quote="it is 0.1"), claim_row("h2", "b", "hyperparameter", "dropout", "7")]  # 7 is out of range
    rows += [claim_row("h3", "a", "hyperparameter", "num_layers", "6"), claim_row("h4", "b", "hyperparameter", "num_layers", "12", confidence=0.3)]  # of low confidence
    rows += [claim_row("h5", "a", "hyperparameter", "batch_size", "32", quote="it is 64"), claim_row("h6", "a", "hyperparameter", "weight_decay", "0.01", status="extracted")]
    d, out = claims_folder(spark, tmp_path, rows), str(tmp_path / "run")
    s = pipeline.run(spark, d, out)
    assert s["conflicts"].isEmpty() and (tmp_path / "run/spec").exists()
    assert sorted(r["exemplar"] for r in s["values"].collect()) == ["h1", "h3", "h5", "h6"]
    assert sum(r["n_claims"] for r in s["clusters"].collect()) == 4
    weak = s["verified"].where("claim_id = 'h5'").first()
    assert (weak["confidence"], weak["stated_explicitly"]) == (0.72, False)
    assert ("b", "dropout") in {(r["paper_id"], r["field"]) for r in s["gaps"].collect()}


def test_paper_components_link_whatever_the_condition(spark, tmp_path):
    own = [("a", "alpha", "rate", None), ("b", "alpha", "rate", "large"), ("c", " alpha", "rate", "base"), ("c", "d", "width", None), ("d", "d", "width", None), ("e", "d", "depth", None), ("f", "alpha", "rate", None), ("g", None, "rate", None), ("h", " ", "rate", "x")]
    rows = [claim_row(f"c{i}", p, "hyperparameter", name, "1", symbol=sym, cond=cond, status="rejected" if p == "f" else "verified") for i, (p, sym, name, cond) in enumerate(own)]
    got = queries.paper_components(spark, claims_folder(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e")]


def test_latex_sections_returns_all_sections(spark, tmp_path):
    texts = ["\\begin{abstract}Short.\\end{abstract}\nBefore.\n\\section{One}\nFirst.\n\\subsection*{Two}\nSecond.\n\\section{Three} Third.", "\\subsection{Only}\nText.", "No markup: sections.", None]
    d = folder(tmp_path, documents=[{"doc_id": i, "paper_id": "p", "section": "s", "text": t} for i, t in enumerate(texts)])
    got = [(r["doc_id"], r["section_index"], r["title"], r["body"].strip()) for r in queries.latex_sections(spark, d).collect()]
    assert got == [(0, 0, "Abstract", "Short."), (0, 1, "Preamble", "Before."), (0, 2, "One", "First."), (0, 3, "Two", "Second."), (0, 4, "Three", "Third."), (1, 0, "Only", "Text.")]


def test_section_triage_decides_for_all_kinds(spark, tmp_path):
    docs = [("p", "Training setup", "x" * 70)] + [("p", f"Part {i}", "y") for i in range(4)] + [("p", "Results", "z" * 9), ("q", "Intro", "x")]
    d = folder(tmp_path, documents=[{"doc_id": i, "paper_id": p, "section": s, "text": t} for i, (p, s, t) in enumerate(docs)])
    got = {(r["paper_id"], r["kind"]): (r["n_matched"], r["decision"]) for r in queries.section_triage(spark, d).collect()}
    assert {k for _, k in got} == {"hyperparameter", "method", "result", "definition"} and len(got) == 8
    assert got["p", "hyperparameter"] == (1, "pattern") and got["p", "result"] == (1, "pattern_fallback") and got["p", "method"] == (0, "all_fallback") and got["q", "definition"][1] == "all"
