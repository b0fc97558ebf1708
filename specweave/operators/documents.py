"""Documents as addressable spans: sections, paragraphs, quotes, references, packing, triage."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from specweave.functions.ids import WS, parse_span, quote_hash, span_id, squeezed
from specweave.functions.text import MATH_LINE, MATH_SHARE, math_share, normalize_text
from specweave.operators.rules import SECTION_PATTERNS
from specweave.session import cut, scan_width

SHORTEST = 20
BUDGET, LEAST_BUDGET, HEADER = 9000, 1000, 8
TRIAGE_SHARE, TRIAGE_LEAST = 0.6, 6
#: Bytes of needles that one automaton holds; more are looked for in further passes over the texts.
NEEDLE_BYTES = 4 << 20
#: Sections of a paper that are numbered or packed in one piece.
PIECE = 4096


def paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs of each text (between blank lines) of at least 20 characters once normalised,
    numbered from 0 in order; texts that are null or without any give none."""
    parts = F.transform(F.split("text", "\n[ \t\r]*\n"), lambda p: normalize_text(p))
    kept = F.filter(parts, lambda p: F.length(p) >= SHORTEST)
    return docs.select("doc_id", "paper_id", "section", F.posexplode(kept).alias("paragraph", "text"))


def in_order(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``df`` (one row per group and order value) with its place in the group, from 0.

    Groups are cut into ranges of the order value, so the rows of a large group are numbered in many
    tasks: within its range, plus what the ranges before it hold."""
    part = F.floor(F.col(order) / PIECE)
    sized = df.groupBy(group, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sized.select(group, "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy(group, "_part").orderBy(order)) - 1
    numbered = df.withColumn("_part", part).withColumn("_own", own)
    return numbered.join(starts, [group, "_part"]).withColumn(name, (F.col("_start") + F.col("_own")).cast("int")).drop("_part", "_own", "_start")


def addressed(docs: DataFrame) -> DataFrame:
    """``(doc_id, paper_id, section_index, paragraph, text)``: the paragraphs that spans address; sections
    are numbered within their paper by doc_id."""
    numbered = in_order(docs.select("doc_id", "paper_id").distinct(), "paper_id", "doc_id", "section_index")
    return paragraphs(docs).join(numbered.select("doc_id", "section_index"), "doc_id").select("doc_id", "paper_id", "section_index", "paragraph", "text")


def spans(docs: DataFrame) -> DataFrame:
    """Paragraphs with span id and quote hash."""
    sid = span_id(F.col("paper_id"), F.col("section_index"), F.col("paragraph"), F.lit(0))
    return addressed(docs).select("doc_id", "paper_id", "section_index", "paragraph", sid.alias("span_id"), F.length("text").alias("n_chars"), quote_hash(F.col("text")).alias("quote_hash"))


def clamp(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """A span kept within its text."""
    s = F.least(F.greatest(start, F.lit(0)), length)
    return s, F.greatest(F.least(end, length), s)


def resolve_spans(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """``claims`` with ``span_text``: what stands at ``span_id`` up to ``char_end`` (absent or null: the end
    of the paragraph) in ``texts`` (see :func:`addressed`). Null for what is no span id, names another
    paper than the claim's, a paragraph that is not there, or begins behind its end."""
    end = F.col("char_end") if "char_end" in claims.columns else F.lit(None).cast("int")
    at = claims.withColumn("_s", parse_span(F.col("span_id"))).withColumn("_end", end)
    p = texts.select(F.col("paper_id").alias("_paper"), F.col("section_index").alias("_section"), F.col("paragraph").alias("_paragraph"), F.col("text").alias("_text"))
    on = (F.col("_s.paper") == F.col("_paper")) & (F.col("paper_id") == F.col("_paper")) & (F.col("_s.section") == F.col("_section")) & (F.col("_s.paragraph") == F.col("_paragraph"))
    n, start = F.length("_text"), F.col("_s.offset").cast("int")
    lo, hi = clamp(start, F.coalesce("_end", n), n)
    found = at.join(p, on, "left")
    return found.withColumn("span_text", F.when(start <= n, F.substring("_text", lo + 1, hi - lo))).drop("_s", "_end", "_paper", "_section", "_paragraph", "_text")


_RUN = re.compile(f"[^{WS[1:-1]}]+")


def _squeezed_at(text: str) -> tuple[str, list[int], list[int]]:
    """The text with blanks squeezed, and where its words begin in it and in the text."""
    here, there, words, n = [], [], [], 0
    for m in _RUN.finditer(text):
        here.append(n)
        there.append(m.start())
        words.append(m.group())
        n += m.end() - m.start() + 1
    return " ".join(words), here, there


def find_spans(needles: DataFrame, texts: DataFrame, scope: str, needle_id: str, text_id: str) -> DataFrame:
    """``(needle_id, text_id, at)``: the first text (by id) of the needle's scope that holds it, white
    space aside; ``at`` counts code points of the text as it is, from 0.

    All needles are looked for in one pass over the texts, by one automaton that every worker holds;
    needles of more than ``NEEDLE_BYTES`` take a pass for each such block. Texts are neither sent nor
    joined; what leaves a task is the first place of a needle in it. Null, empty and blank needles are
    found nowhere, and a needle is looked for in texts of its own scope alone (null is none)."""
    n = needles.select(F.col(needle_id), F.col(scope).alias("scope"), squeezed(F.col("needle")).alias("needle")).where("needle <> '' and scope is not null").distinct()
    n = cut(n, "needles")
    total = n.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    blocks = -(-total // NEEDLE_BYTES)
    schema = T.StructType([*n.select(needle_id).schema.fields, *texts.select(text_id).schema.fields, T.StructField("at", T.IntegerType())])
    source = scan_width(texts.select(F.col(text_id), F.col(scope).alias("scope"), "text").where("text is not null and scope is not null"))
    empty = source.sparkSession.createDataFrame([], schema)
    found = [_find_block(n.where(F.pmod(F.xxhash64(needle_id, "needle"), F.lit(blocks)) == k), source, schema) for k in range(blocks)]
    every = reduce(DataFrame.unionAll, found, empty)
    return every.groupBy(needle_id).agg(F.min(F.struct(text_id, "at")).alias("hit")).select(needle_id, f"hit.{text_id}", "hit.at")


def _find_block(needles: DataFrame, source: DataFrame, schema: T.StructType) -> DataFrame:
    rows = [tuple(r) for r in needles.collect()]  # a block of bounded size
    shared = source.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple]] = {}
        for nid, where, needle in shared.value:
            owners.setdefault(needle, []).append((nid, where))
        for needle, who in owners.items():
            automaton.add_word(needle, (len(needle), who))
        if owners:
            automaton.make_automaton()
        best: dict[tuple, tuple] = {}
        for b in batches if owners else ():
            for tid, where, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body, here, there = _squeezed_at(text)
                for end, (length, who) in automaton.iter(body):
                    start = end - length + 1
                    word = bisect_right(here, start) - 1
                    place = (tid, there[word] + start - here[word])
                    for nid, own in who:
                        if own == where and (best.get(nid) is None or place < best[nid]):
                            best[nid] = place
        if best:
            ids, places = list(best), list(best.values())
            cols = [ids, [t for t, _ in places], [a for _, a in places]]
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(cols, schema.fields, strict=True)], schema.names)

    return source.mapInArrow(run, schema)


def references(docs: DataFrame) -> DataFrame:
    """Numbered entries of reference lists: key, year, first words."""
    lines = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(\[\d+\] [^\n]+)"), 1)).alias("line"))
    key = F.regexp_extract("line", r"^\[(\d+)\]", 1)
    raw = F.substring(F.regexp_replace("line", r"^\[\d+\] ", ""), 1, 500)
    year = F.nullif(F.regexp_extract("line", r"((?:19|20)\d\d)", 1), F.lit("")).cast("int")
    return lines.select("doc_id", key.cast("int").alias("ref_key"), raw.alias("raw"), year.alias("year"))


def suspect_math_lines(docs: DataFrame) -> DataFrame:
    """Lines of text that are mostly formula: how many a document has."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    return lines.where((F.length("line") >= MATH_LINE) & (math_share(F.col("line")) >= MATH_SHARE)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


def triage(docs: DataFrame, kind: str) -> DataFrame:
    """Which way a paper's sections are chosen for one kind of fact: all of a short paper, else those
    whose titles match if they are enough of the text, else whatever an external choice says."""
    hit = F.col("section").rlike(SECTION_PATTERNS[kind])
    n = F.length("text")
    per = docs.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_sections"), F.count_if(hit).alias("n_matched"), F.sum(F.coalesce(F.when(hit, n), F.lit(0))).alias("matched_chars"), F.sum(F.coalesce(n, F.lit(0))).alias("all_chars"))
    how = F.when(F.col("n_sections") < TRIAGE_LEAST, "all").when(F.col("matched_chars") >= TRIAGE_SHARE * F.col("all_chars"), "pattern").when(F.col("n_matched") > 0, "pattern_fallback").otherwise("all_fallback")
    return per.select("paper_id", F.lit(kind).alias("kind"), "n_sections", "n_matched", how.alias("decision"))


def _outcomes(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """For each section, if a batch begins with it: how many batches begin from there on, and how full
    the last one is in the end."""
    n, ahead, total = len(sizes), 0, 0
    after = []
    for i in range(n):  # where the batch ends that begins with section i
        if ahead <= i:
            ahead, total = i + 1, sizes[i]
        while ahead < n and total + sizes[ahead] <= room:
            total += sizes[ahead]
            ahead += 1
        after.append((ahead, total))
        total -= sizes[i]
    out: list[tuple[int, int]] = [(0, 0)] * n
    for i in reversed(range(n)):
        end, used = after[i]
        out[i] = (1, used) if end == n else (1 + out[end][0], out[end][1])
    return out


def pack(docs: DataFrame, budget: int = BUDGET, overhead: int = 0) -> DataFrame:
    """Sections packed in order into batches of bounded size, greedily; an oversize one stands alone.

    A fold in order, over pieces of a paper. What a piece does to the fold depends only on where in it
    the batch ends that it begins in, and that is within its first ``room`` characters; so each piece
    tells for each such place how many batches follow and how full the last one is (a bounded list),
    these are chained paper by paper, and then every piece is packed by itself."""
    room = max(LEAST_BUDGET, budget - overhead)
    sized = docs.select("paper_id", "doc_id", (F.length(F.coalesce("text", F.lit(""))) + F.length(F.coalesce("section", F.lit(""))) + HEADER).alias("size"))
    sized = sized.withColumn("piece", F.floor(F.col("doc_id") / PIECE))
    ordered = sized.repartition("paper_id", "piece").sortWithinPartitions("paper_id", "piece", "doc_id")

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own = None, []

        def told() -> pd.DataFrame:
            outcomes, places, total = _outcomes(own, room), 0, 0
            while places < len(own) and total <= room:
                total += own[places]
                places += 1
            heads = outcomes[:places]
            return pd.DataFrame([(*held, own[:places], [b for b, _ in heads], [u for _, u in heads])], columns=["paper_id", "piece", "sizes", "more", "used"])

        for pdf in batches:
            for p, number, size in zip(pdf["paper_id"], pdf["piece"], pdf["size"], strict=True):
                if (p, number) != held:
                    if held is not None:
                        yield told()
                    held, own = (p, number), []
                own.append(int(size))
        if held is not None:
            yield told()

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paper, batch, used = None, 0, 0
        for pdf in batches:
            out = []
            for p, number, own, more, last in zip(*(pdf[c] for c in ("paper_id", "piece", "sizes", "more", "used")), strict=True):
                if p != paper:
                    paper, batch, used = p, 0, 0
                out.append((p, number, batch, used))
                for size, n, rest in zip(own, more, last, strict=True):
                    if used and used + size > room:
                        batch, used = batch + int(n), int(rest)
                        break
                    used += int(size)
            yield pd.DataFrame(out, columns=["paper_id", "piece", "first_batch", "first_used"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, used = None, 0, 0
        for pdf in batches:
            out = []
            for p, number, size, first_batch, first_used in zip(*(pdf[c] for c in ("paper_id", "piece", "size", "first_batch", "first_used")), strict=True):
                if (p, number) != at:
                    at, batch, used = (p, number), first_batch, first_used
                batch, used = (batch + 1, size) if used and used + size > room else (batch, used + size)
                out.append(batch)
            yield pdf[["paper_id", "doc_id", "size"]].assign(batch=out)

    heads = ordered.mapInPandas(tell, "paper_id string, piece bigint, sizes array<int>, more array<int>, used array<int>")
    starts = heads.repartition("paper_id").sortWithinPartitions("paper_id", "piece").mapInPandas(chain, "paper_id string, piece bigint, first_batch int, first_used int")
    joined = sized.join(starts, ["paper_id", "piece"]).repartition("paper_id", "piece").sortWithinPartitions("paper_id", "piece", "doc_id")
    return joined.mapInPandas(fold, "paper_id string, doc_id bigint, size int, batch int")


def same_texts(docs: DataFrame) -> DataFrame:
    """Texts that are equal but for white space: hash, number of documents, first of them."""
    t = docs.where(f"text is not null and text rlike '[^{WS[1:-1]}]'")
    return t.groupBy(quote_hash(F.col("text")).alias("quote_hash")).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")
