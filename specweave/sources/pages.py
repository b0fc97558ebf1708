"""Text layers of page-wise files, math review of what was read, and which reader a reference takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.functions.text import arxiv_id, formula_quality, normalize_text
from specweave.operators.documents import SHORTEST

#: Separates the pages of a text layer.
PAGE = "\f"


def page_paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, page, paragraph, text)``: the paragraphs of each page (from 1) of a text layer, numbered
    through the document; those shorter than ``SHORTEST`` once normalised are none."""
    pages = docs.select("doc_id", F.posexplode(F.split("text", PAGE)).alias("page", "body"))
    parts = pages.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode(F.transform(F.split("body", "\n[ \t\r]*\n"), normalize_text)).alias("at", "text")).where(F.length("text") >= SHORTEST)
    # A document's paragraphs are one row's own, so they are numbered next to it.
    held = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "at", "text"))).alias("p"))
    return held.select("doc_id", F.posexplode("p").alias("paragraph", "x")).select("doc_id", "x.page", "paragraph", "x.text")


def reader_of(ref: Column) -> Column:
    """Which reader takes a reference: a preprint id, a page file, LaTeX sources or XML; null for none."""
    name = F.lower(F.trim(ref))
    return F.when(arxiv_id(F.trim(ref)).isNotNull(), "preprint").when(name.endswith(".pdf"), "pages").when(name.rlike(r"\.(?:tex|tar|tar\.gz|tgz)$|/$"), "latex").when(name.rlike(r"\.(?:xml|tei)$"), "tei")


def review_formulas(formulas: DataFrame, recovered: DataFrame | None = None) -> DataFrame:
    """Formulas with ``fidelity`` after review: of those from a text layer, unreadable ones are replaced by
    what was recovered (``key, latex``) and marked so, or marked suspect; others stay as they are."""
    q = formulas.withColumn("problem", F.when(F.col("fidelity") == "text_layer", formula_quality(F.col("latex"))))
    fix = F.lit(None).cast("string")
    if recovered is not None:
        q = q.join(recovered.groupBy("key").agg(F.min("latex").alias("_fix")), "key", "left")
        fix = F.col("_fix")
    bad = F.col("problem").isNotNull()
    q = q.withColumn("fidelity", F.when(bad & fix.isNotNull(), "ocr_recovered").when(bad, "text_layer_suspect").otherwise(F.col("fidelity")))
    return q.withColumn("latex", F.when(bad, F.coalesce(fix, "latex")).otherwise(F.col("latex"))).drop("_fix")


def document_fidelity(formulas: DataFrame) -> DataFrame:
    """``(doc_id, fidelity)``: how far a document's formulas can be trusted: that of the degraded ones, the
    alphabetically first, else what they all have."""
    weak = F.col("fidelity").isin("ocr_recovered", "text_layer_suspect")
    return formulas.groupBy("doc_id").agg(F.coalesce(F.min(F.when(weak, F.col("fidelity"))), F.min("fidelity")).alias("fidelity"))
