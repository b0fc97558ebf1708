"""Sources, stage tables, streams."""

from pyspark.sql import functions as F

from specweave.sources import latex, pages, store, tei
from specweave.streaming import ledger

TEX = r"""
\title{Sample} \date{May 2021} % not \section{this}
\begin{document}
\begin{abstract} We study \emph{things}. \end{abstract}
Before.
\section{Intro}
See \citep{bahdanau2014,other} and $d_k$ at 50\%.
\begin{equation}\label{eq:a} a  =
 b + c \end{equation}
\begin{figure} gone \end{figure}
\subsection{} More~text.
\input{extra}
\begin{thebibliography}{9}\bibitem{bahdanau2014} Neural MT. arXiv:1409.0473, 2014.\end{thebibliography}
\end{document}
"""


def test_latex(spark):
    files = spark.createDataFrame([("p", "/x/main.tex", TEX), ("p", "/x/extra.tex", "\\section{Extra} from input %\\input{no}"), ("q", "/y/a.tex", None)], "paper_id string, path string, content string")
    src = latex.joined_sources(files)
    assert "from input" in src.where("paper_id = 'p'").first()["source"] and src.where("paper_id = 'q'").first()["source"] is None
    parsed = latex.sections(src.where("paper_id = 'p'"))
    got = [(r["title"], r["body"].strip()) for r in latex.plain_sections(parsed).orderBy("section_index").collect()]
    assert [t for t, _ in got] == ["Abstract", "Preamble", "Intro", "Section 3", "Extra"]
    assert got[0][1] == "We study things." and got[2][1].startswith("See [bahdanau2014] and d_k at 50%.") and "gone" not in got[2][1]
    eq = latex.equations(parsed, "paper_id", parsed["body"]).collect()
    assert [(e["label"], e["latex"]) for e in eq] == [("eq:a", "a = b + c")]
    b = latex.bibliography(src.where("paper_id = 'p'")).first()
    assert (b["ref_key"], b["arxiv_id"]) == ("bahdanau2014", "1409.0473")


def test_latex_floats_and_front_matter(spark):
    tex = r"\title[Short]{A \emph{Big} Title}\date{March 2019}\begin{document}\[ x = 1 \] a\\[2pt] \begin{flalign*}\label{eq:f} y = 2\end{flalign*}\begin{algorithm2e}\caption{Do \textbf{it}}\label{a:1} go\end{algorithm2e}\[ \]\begin{thebibliography}{1}\bibitem{x} 1999.\end{thebibliography}\end{document}"
    df = spark.createDataFrame([("p", tex), ("q", "Copyright 2001 \\begin{document} since 1998"), ("r", None)], "paper_id string, source string")
    assert [(r["label"], r["latex"]) for r in latex.equations(df, "paper_id", "source").orderBy("equation_index").collect()] == [("eq:f", "y = 2"), (None, "x = 1")]
    assert [tuple(r) for r in latex.algorithms(df, "paper_id", "source").collect()] == [("p", 0, "a:1", "Do it", "\\caption{Do \\textbf{it}}\\label{a:1} go")]
    assert [tuple(r) for r in latex.front_matter(df).orderBy("paper_id").collect()] == [("p", "A Big Title", 2019, None), ("q", None, 2001, None), ("r", None, None, None)]
    meta = spark.createDataFrame([("p", " ", 2020, "ACL"), ("q", "Named", None, None)], "paper_id string, title string, year int, venue string")
    assert [tuple(r) for r in latex.with_metadata(latex.front_matter(df).drop("abstract"), meta).orderBy("paper_id").collect()] == [("p", "A Big Title", 2020, "ACL"), ("q", "Named", 2001, None), ("r", None, None, None)]


def test_pages_readers_and_review(spark):
    d = spark.createDataFrame([(1, "First page with enough words.\n\nshort\fSecond page with enough words."), (2, None), (3, "")], "doc_id bigint, text string")
    assert [tuple(r) for r in pages.page_paragraphs(d).collect()] == [(1, 1, 0, "First page with enough words."), (1, 2, 1, "Second page with enough words.")]
    refs = {"1706.03762v2": "preprint", "a/b.PDF": "pages", "a/main.tex": "latex", "a/src.tar.gz": "latex", "a/b.tei": "tei", "notes": None}
    assert [r[0] for r in spark.createDataFrame([(x,) for x in refs], "r string").select(pages.reader_of(F.col("r"))).collect()] == list(refs.values())
    f = spark.createDataFrame([(1, "k1", "a = b + c", "text_layer"), (1, "k2", "f(x = {12}", "text_layer"), (1, "k3", "((((((", "text_layer"), (2, "k4", "((((((", "latex_native")], "doc_id int, key string, latex string, fidelity string")
    fix = spark.createDataFrame([("k2", "f(x) = 12")], "key string, latex string")
    got = pages.review_formulas(f, fix)
    assert [(r["latex"], r["fidelity"]) for r in got.orderBy("key").collect()] == [("a = b + c", "text_layer"), ("f(x) = 12", "ocr_recovered"), ("((((((", "text_layer_suspect"), ("((((((", "latex_native")]
    assert [tuple(r) for r in pages.document_fidelity(got).orderBy("doc_id").collect()] == [(1, "ocr_recovered"), (2, "latex_native")]


def test_ledger_and_fingerprint(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path / "run"))
    assert s.ledger().count() == 0 and s.facts() == {}
    calls = spark.createDataFrame([("extract", "a", 10)], "stage string, provider string, input_tokens bigint")
    s.log(calls)
    s.log(calls)
    (tmp_path / "run" / "ledger" / "bad.json").write_text("{cut off\n")
    assert s.ledger().count() == 2 and s.ledger().agg({"input_tokens": "sum"}).first()[0] == 20
    s.manifest(draft=True, fingerprint="x")
    assert s.facts() == {"draft": True, "fingerprint": "x"}
    papers = spark.createDataFrame([("p", "1"), ("q", None)], "paper_id string, sha256 string")
    one = store.fingerprint({"a": 1, "b": [2]}, papers)
    assert one == store.fingerprint({"b": [2], "a": 1}, papers.orderBy("paper_id", ascending=False)) and one != store.fingerprint({"a": 1, "b": [3]}, papers) and one != store.fingerprint({"a": 1, "b": [2]}, papers.limit(1))


def test_read_latex(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "main.tex").write_text(TEX)
    assert latex.read_latex(spark, str(tmp_path)).first()["paper_id"] == "p1"


def test_tei(spark):
    xml = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><abstract><p>Short  text.</p></abstract><text><body><div><head n="1">Intro</head><p>One.</p><formula>a=b</formula></div><div><p/></div></body></text></TEI>'
    rows = tei.tei_items(spark.createDataFrame([("p", xml), ("q", "<bad"), ("r", None)], "paper_id string, xml string")).collect()
    assert [(r["title"], r["kind"], r["text"]) for r in rows] == [("Abstract", "paragraph", "Short text."), ("1 Intro", "paragraph", "One."), ("1 Intro", "equation", "a=b")]


def test_store_resumes(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path / "run"))
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert s.stage("a", make).count() == 3 and s.stage("a", make).count() == 3 and len(made) == 1
    assert s.stage("a", make, resume=False).count() == 3 and len(made) == 2
    assert s.missing("a", spark.range(5), "id").count() == 2 and s.missing("b", spark.range(5), "id").count() == 5
    s.spec(spark.range(1), draft=True)
    assert (tmp_path / "run" / "spec.draft").exists()
    s.spec(spark.range(1), draft=False)
    assert not (tmp_path / "run" / "spec.draft").exists() and (tmp_path / "run" / "spec").exists()


def test_stream_equals_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ledger.daily_usage(ledger.read_stream(spark, str(tmp_path / "in"), events.schema), late="400 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    tidy = lambda df: sorted((str(r["day"]), r["provider"], r["calls"], round(r["amount"], 6)) for r in df.collect())
    assert tidy(spark.table("usage")) == tidy(ledger.daily_usage(events))
    assert ledger.sessions(events).agg({"n_events": "sum"}).first()[0] == events.count()
