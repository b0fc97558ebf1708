"""LaTeX sources as tables: sections, equations, references of one row a file set."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.functions.text import tex_comments, tex_plain, year_in

# Environments of displayed mathematics.
MATH_ENVIRONMENTS = ["equation", "align", "gather", "multline", "eqnarray", "flalign", "displaymath"]
# Environments of algorithms.
ALGORITHM_ENVIRONMENTS = ["algorithm", "algorithmic", "algorithm2e"]
# Usual names of a main file.
MAIN_NAMES = ["main", "paper", "ms", "article", "root", "arxiv"]
DEPTH = 3

_MATH = r"(?s)\\begin\{(" + "|".join(MATH_ENVIRONMENTS) + r")\*?\}(.*?)\\end\{\1\*?\}"
_DISPLAYED = r"(?s)(?<!\\)\\\[(.*?)(?<!\\)\\\]"
_ALGORITHM = r"(?s)\\begin\{(" + "|".join(ALGORITHM_ENVIRONMENTS) + r")\*?\}(.*?)\\end\{\1\*?\}"
_SECTION = r"\\(?:sub){0,2}section\*?\{"
#: What a text has that can be cut into LaTeX sections.
SECTIONED = _SECTION + r"|\\begin\{(?:abstract|document)\}"


def joined_sources(files: DataFrame) -> DataFrame:
    """``(paper_id, source)`` from ``(paper_id, path, content)``: the main file with its inputs.

    Main is the file that begins the document, a usual name first; inputs are put in place to a depth
    of three, missing ones are empty; comments are cut first, so what is commented out is not read. A
    paper's files are few and meet in one task."""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = {re.sub(r"^.*/", "", p): re.sub(r"(?<!\\)%[^\n]*", "", c) for p, c in zip(pdf["path"], pdf["content"], strict=True) if isinstance(c, str)}
        rank = lambda n: (MAIN_NAMES.index(n[:-4]) if n[:-4] in MAIN_NAMES else len(MAIN_NAMES), n)
        mains = sorted((n for n, c in texts.items() if "\\begin{document}" in c), key=rank)

        def put(text: str, depth: int) -> str:
            if depth == 0:
                return text
            at = lambda m: put(texts.get(m[1].strip(), texts.get(m[1].strip() + ".tex", "")), depth - 1)
            return re.sub(r"\\(?:input|include)\{([^{}]+)\}", at, text)

        source = put(texts[mains[0]], DEPTH) if mains else None
        return pd.DataFrame({"paper_id": [pdf["paper_id"].iloc[0]], "source": [source]})

    return files.select("paper_id", "path", "content").groupBy("paper_id").applyInPandas(whole, "paper_id string, source string")


def sections(sources: DataFrame) -> DataFrame:
    """``(paper_id, section_index, title, body)``: the abstract first, then sections of all levels in
    order; text before the first is the preamble; a text without any is one body."""
    clean = sources.select("paper_id", tex_comments(F.col("source")).alias("t"))
    body = F.regexp_extract("t", r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|\z)", 1)
    clean = clean.withColumn("t", F.when(body != "", body).otherwise(F.col("t")))
    abstract = F.regexp_extract("t", r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", 1)
    rest = F.regexp_replace("t", r"(?s)\\begin\{abstract\}.*?\\end\{abstract\}|\\begin\{thebibliography\}.*?\\end\{thebibliography\}", "")
    parts = F.split(rest, _SECTION)
    head = F.element_at(parts, 1)
    cut_up = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.struct(tex_plain(F.regexp_extract(p, r"(?s)^([^{}]*)\}", 1)).alias("title"), F.regexp_replace(p, r"(?s)^[^{}]*\}", "").alias("body")))
    front = lambda name, text: F.when(text.rlike(r"\S"), F.array(F.struct(F.lit(name).alias("title"), text.alias("body")))).otherwise(F.array().cast("array<struct<title:string,body:string>>"))
    only = F.when(F.size(parts) == 1, front("Body", head)).otherwise(front("Preamble", head))
    every = F.concat(front("Abstract", abstract), only, cut_up)
    out = clean.select("paper_id", F.posexplode(every).alias("section_index", "s"))
    title = F.when(F.col("s.title") == "", F.concat(F.lit("Section "), F.col("section_index"))).otherwise(F.col("s.title"))
    return out.select("paper_id", "section_index", title.alias("title"), F.col("s.body").alias("body"))


def _label(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, r"\\label\{([^}]*)\}", 1), F.lit(""))


def equations(df: DataFrame, key: str, text: str | Column) -> DataFrame:
    """Displayed formulas: those of environments in order, then those in brackets; label, formula with
    white space squeezed. Empty brackets are none."""
    text = F.col(text) if isinstance(text, str) else text
    bracketed = F.filter(F.regexp_extract_all(text, F.lit(_DISPLAYED), 1), lambda x: F.trim(x) != "")
    found = F.concat(F.regexp_extract_all(text, F.lit(_MATH), 2), bracketed)
    e = df.select(key, F.posexplode(found).alias("equation_index", "raw"))
    latex = F.trim(F.regexp_replace(F.regexp_replace("raw", r"\\label\{[^}]*\}", ""), r"\s+", " "))
    return e.select(key, "equation_index", _label(F.col("raw")).alias("label"), latex.alias("latex"))


def algorithms(df: DataFrame, key: str, text: str | Column) -> DataFrame:
    """Algorithm floats in order: label, caption, body."""
    text = F.col(text) if isinstance(text, str) else text
    a = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(_ALGORITHM), 2)).alias("algorithm_index", "raw"))
    caption = F.nullif(tex_plain(F.regexp_extract("raw", r"\\caption\{((?:[^{}]|\{[^{}]*\})*)\}", 1)), F.lit(""))
    return a.select(key, "algorithm_index", _label(F.col("raw")).alias("label"), caption.alias("caption"), F.trim("raw").alias("body"))


def front_matter(sources: DataFrame) -> DataFrame:
    """``(paper_id, title, year, abstract)``: what stands before the text. The year is that of the date, else
    of the preamble, never of the references; what is not there is null."""
    s = sources.select("paper_id", tex_comments(F.col("source")).alias("t"))
    part = lambda pattern: F.nullif(tex_plain(F.regexp_extract("t", pattern, 1)), F.lit(""))
    preamble = F.element_at(F.split("t", r"\\begin\{document\}"), 1)
    dated = year_in(F.regexp_extract("t", r"\\date\s*\{([^{}]*)\}", 1))
    return s.select("paper_id", part(r"\\title(?:\[[^\]]*\])?\s*\{((?:[^{}]|\{[^{}]*\})*)\}").alias("title"), F.coalesce(dated, year_in(preamble)).alias("year"), part(r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}").alias("abstract"))


def with_metadata(parsed: DataFrame, metadata: DataFrame) -> DataFrame:
    """``parsed`` (paper_id, title, year, ..) with title, year and venue of a catalogue where it has them."""
    m = metadata.groupBy("paper_id").agg(*(F.min(F.nullif(F.trim(c), F.lit("")) if c != "year" else F.col(c)).alias(f"_{c}") for c in ("title", "year", "venue")))
    out = parsed.join(m, "paper_id", "left")
    venue = F.col("venue") if "venue" in parsed.columns else F.lit(None).cast("string")
    return out.withColumns({"title": F.coalesce("_title", "title"), "year": F.coalesce("_year", "year"), "venue": F.coalesce("_venue", venue)}).drop("_title", "_year", "_venue")


def bibliography(sources: DataFrame) -> DataFrame:
    """Entries of the bibliography: key, text to 500 characters, preprint id, year."""
    parts = F.split("source", r"\\bibitem")
    items = sources.select("paper_id", F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("b"))
    key = F.regexp_extract("b", r"^(?:\[[^\]]*\])?\{([^{}]*)\}", 1)
    raw = F.substring(tex_plain(F.regexp_replace("b", r"(?s)^(?:\[[^\]]*\])?\{[^{}]*\}|\\end\{thebibliography\}.*", "")), 1, 500)
    arxiv = F.nullif(F.regexp_extract(raw, r"(\d{4}\.\d{4,5})", 1), F.lit(""))
    return items.select("paper_id", key.alias("ref_key"), raw.alias("raw"), arxiv.alias("arxiv_id"), year_in(raw).alias("year"))


def plain_sections(parsed: DataFrame) -> DataFrame:
    """Section bodies without floats and markup."""
    floats = r"(?s)\\begin\{(figure|table|algorithm|algorithmic|algorithm2e|" + "|".join(MATH_ENVIRONMENTS) + r")\*?\}.*?\\end\{\1\*?\}"
    bare = F.regexp_replace(F.regexp_replace("body", floats, ""), _DISPLAYED, "")
    return parsed.withColumn("body", tex_plain(bare))


def read_latex(spark, path: str) -> DataFrame:
    """``(paper_id, path, content)`` of all .tex files under ``path``; the folder names the paper."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.tex").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -2).alias("paper_id"), "path", F.decode("content", "UTF-8").alias("content"))

