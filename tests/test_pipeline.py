"""The run as a whole, decisions, commands."""

from specweave.plans import cli, pipeline
from specweave.sources.store import RunStore


def test_run_decide_and_resume(spark, sf, tmp_path):
    out = str(tmp_path / "run")
    s = pipeline.run(spark, sf, out)
    found = s["conflicts"].count()
    first = sorted(map(str, s["values"].collect()))
    assert found > 0 and first
    assert (tmp_path / "run" / "spec.draft").exists() == (not s["blocking"].isEmpty())
    again = pipeline.run(spark, sf, out)
    assert sorted(map(str, again["values"].collect())) == first
    c, d = s["conflicts"].take(2)
    assert not pipeline.decide(spark, sf, out, c["contradiction_id"], "no such claim")
    assert pipeline.decide(spark, sf, out, c["contradiction_id"], c["positions"][0]["claim_id"])
    r = RunStore(spark, out).read("05_resolutions").where(f"contradiction_id = '{c['contradiction_id']}'").collect()
    assert len(r) == 1 and r[0]["resolved_by"] == "human"
    assert pipeline.decide(spark, sf, out, d["contradiction_id"], d["positions"][0]["claim_id"])
    assert RunStore(spark, out).read("05_resolutions").where("resolved_by = 'human'").count() == 2
    assert cli.main(["conflicts", "--out", out]) == 2 and cli.main(["gaps", "--out", out]) == 0
    assert cli.main(["diff", "--data", sf]) == 3 and cli.main(["query", "gap_summary", "--data", sf]) == 0
    assert cli.main(["doctor", "--data", sf]) == 0 and cli.main(["doctor", "--data", str(tmp_path)]) == 2
    assert cli.main(["extractors"]) == 0 and cli.main(["detectors"]) == 0 and cli.main(["schema", "04_conflicts", "--out", out]) == 0
    assert cli.main(["validate-schemas", "--data", sf]) == 2 and cli.main(["models", "--data", sf]) == 0
    told = pipeline.review_document(spark, out)
    assert told.startswith("# Review") and "## Decided conflicts: 2" in told
    # A decision outlives the stage that it was written into.
    RunStore(spark, out).write("05_resolutions", pipeline.resolutions(s["conflicts"], spark.read.parquet(f"{sf}/papers.parquet")))
    again = pipeline.run(spark, sf, out)
    assert again["resolutions"].where("resolved_by = 'human'").count() == 2
    assert again["closure"].first()["completeness"] == 1.0


def test_another_fingerprint_is_not_resumed(spark, sf, tmp_path, monkeypatch):
    out = str(tmp_path / "run")
    pipeline.run(spark, sf, out)
    store = RunStore(spark, out)
    before, made = store.facts()["fingerprint"], (tmp_path / "run/03_clusters/_SUCCESS").stat().st_mtime_ns
    pipeline.run(spark, sf, out)
    assert (tmp_path / "run/03_clusters/_SUCCESS").stat().st_mtime_ns == made
    monkeypatch.setitem(pipeline.SETTINGS, "confident", 0.7)
    pipeline.run(spark, sf, out)
    assert store.facts()["fingerprint"] != before and (tmp_path / "run/03_clusters/_SUCCESS").stat().st_mtime_ns > made


def test_pipeline_traces_quotes(spark, tmp_path):
    """Three papers: what a paper does not say is rejected; one planted conflict is found and none made up."""
    import hashlib

    from specweave.operators import documents
    from tests.test_whole import CLAIM, folder

    texts = {"a": "We train with a dropout rate of 0.1 throughout.", "b": "Our dropout rate is set to 0.3 in all runs.", "c": "Six layers are used, as in the base model."}
    d = folder(tmp_path, papers=[{"paper_id": p, "title": p, "venue": None, "year": 2020, "sha256": p} for p in texts], documents=[{"doc_id": i, "paper_id": p, "section": "S", "text": t} for i, (p, t) in enumerate(texts.items())])
    said = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    rows = [("c1", "a", "dropout", "0.1", "a#s0.p0.0", said(texts["a"])), ("c2", "b", "dropout", "0.3", "b#s0.p0.0", said(texts["b"])), ("c3", "c", "dropout", "0.5", "c#s0.p0.0", said("dropout 0.5")), ("c4", "c", "num_layers", "6", "c#s9.p0.0", said(texts["c"])), ("c5", "c", "num_heads", "6", "c#s0.p0.0", said(texts["c"]))]
    schema = CLAIM.replace("section string>", "section string, char_end int, quote_hash string>")
    full = [(i, p, "hyperparameter", n, v, "global", texts[p], 0.9, "extracted", None, "float", None, None, True, (span, f"{p}#s0", "S", None, h), ("pass", "n/a"), None) for i, p, n, v, span, h in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{d}/claims.parquet")
    s = pipeline.run(spark, d, str(tmp_path / "run"), texts=documents.addressed(spark.read.parquet(f"{d}/documents.parquet")))
    got = {r["claim_id"]: (r["status"], r["stated_explicitly"]) for r in s["verified"].collect()}
    assert got == {"c1": ("verified", True), "c2": ("verified", True), "c3": ("rejected", True), "c4": ("rejected", True), "c5": ("verified", False)}
    assert [(r["conflict_type"], r["name_key"], [p["claim_id"] for p in r["positions"]]) for r in s["conflicts"].collect()] == [("VALUE_CONFLICT", "dropout", ["c1", "c2"])]
