"""Text as it comes from documents: normalising, numbers, citations, markup, damaged formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from specweave.functions.ids import WS

# Characters of PDF text layers and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "\xa0": " "}
WORD = r"[\p{L}\p{N}_]"


def normalize_text(text: Column) -> Column:
    """Text as it is stored at ingest: ligatures spelt out, words joined over line breaks, blank runs
    squeezed, lines stripped, no empty lines. Null stays null."""
    t = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), text)
    t = F.regexp_replace(t, rf"({WORD})-{WS}*\n{WS}*({WORD})", "$1$2")
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, "\n{2,}", "\n")
    return F.regexp_replace(F.regexp_replace(t, f"(?dm)^{WS}+|{WS}+$", ""), rf"\A{WS}+|{WS}+\z", "")


_PLAIN = r"(?<![\w.])([-+−]?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?)(?!\w)"
_SCIENTIFIC = r"([-+−]?\d+(?:\.\d+)?)\s*(?:x|×|\*|·)\s*10\s*\^?\s*\{?([-+−]?\d+)\}?"


def numbers_in(text: Column) -> Column:
    """All numbers written in a text: plain ones, thousands commas included, and ``m x 10^e``."""
    tidy = lambda x: F.replace(F.replace(x, F.lit(","), F.lit("")), F.lit("−"), F.lit("-"))
    plain = F.transform(F.regexp_extract_all(text, F.lit(_PLAIN), 1), lambda x: tidy(x).try_cast("double"))
    heads = F.regexp_extract_all(text, F.lit(_SCIENTIFIC), 1)
    tails = F.regexp_extract_all(text, F.lit(_SCIENTIFIC), 2)
    sci = F.zip_with(heads, tails, lambda m, e: F.concat(tidy(m), F.lit("e"), tidy(e)).try_cast("double"))
    return F.filter(F.concat(sci, plain), lambda x: x.isNotNull())


def citation_keys(text: Column) -> Column:
    """Bracketed keys that look like citations: a letter first, three characters or more, with a
    digit, and not all in capitals."""
    found = F.regexp_extract_all(text, F.lit(r"\[([A-Za-z][A-Za-z0-9_:.-]{2,})\]"), 1)
    return F.filter(found, lambda k: k.rlike(r"\d") & ~k.rlike(r"^[A-Z0-9_:.-]+$"))


def year_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d\d)\b", 1), F.lit("")).cast("int")


def arxiv_id(ref: Column) -> Column:
    """A preprint id without version, of the modern or the older kind; null if there is none."""
    modern = F.regexp_extract(ref, r"(?:^|[/:\s])(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?/?$", 1)
    older = F.regexp_extract(ref, r"(?:^|[/:\s])([a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?(?:\.pdf)?/?$", 1)
    return F.nullif(F.when(modern != "", modern).otherwise(older), F.lit(""))


def venue_in(comment: Column) -> Column:
    """The venue that a submission comment names ("accepted at", "to appear in")."""
    got = F.regexp_extract(comment, r"(?i)(?:accepted (?:at|to|by|for)|published (?:at|in)|appear(?:s|ed)? (?:at|in)|presented at)\s+([^.;,()]+)", 1)
    return F.nullif(F.trim(got), F.lit(""))


# Phrases that propose an answer; letter case does not count.
SUGGESTING_PHRASES = [
    "probably", "likely", "presumably", "most likely", "we suggest", "we recommend", "i would use", "i would suggest", "i would recommend", "you should use", "you could use",
    "recommend", "recommended", "suggest", "suggested", "default to", "defaults to", "assume", "a reasonable default", "a reasonable choice", "commonly",
]
SUGGESTING = r"(?i)\b(?:" + "|".join(SUGGESTING_PHRASES) + r")\b"


def strip_suggestion(question: Column) -> Column:
    """A question without the sentences that propose an answer; empty if none is left."""
    sentences = F.split(question, r"(?<=[.?!])\s+")
    return F.trim(F.concat_ws(" ", F.filter(sentences, lambda s: ~s.rlike(SUGGESTING))))


# Formulas --------------------------------------------------------------------------------------

MATH_SHARE, MATH_LINE = 0.12, 8
UNUSABLE_SHARE, SHORTEST_FORMULA = 0.08, 6
_UNUSABLE = r"[\p{Co}\p{Cc}\x{FFFD}\x{FEFF}&&[^\t\n\r]]|\p{Cn}"


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def formula_quality(latex: Column) -> Column:
    """Why a formula cannot be read: null if it can."""
    bare = F.regexp_replace(latex, r"\\[(){}\[\]]", "")
    uneven = reduce(lambda a, b: a | b, (count_of(bare, o) != count_of(bare, c) for o, c in ((r"\(", r"\)"), (r"\[", r"\]"), (r"\{", r"\}"))))
    sides = F.size(F.regexp_extract_all(latex, F.lit(r"\\left(?![a-z])"), 0)) != F.size(F.regexp_extract_all(latex, F.lit(r"\\right(?![a-z])"), 0))
    bad = F.length(latex) - F.length(F.regexp_replace(latex, _UNUSABLE, ""))
    return (
        F.when(F.coalesce(F.trim(latex), F.lit("")) == "", "empty")
        .when(F.length(F.trim(latex)) < SHORTEST_FORMULA, "too short")
        .when(bad > UNUSABLE_SHARE * F.length(latex), "unusable characters")
        .when(uneven, "unbalanced brackets")
        .when(sides, "unbalanced left and right")
    )


# Characters that make a line of text look like a formula.
MATH_GLYPHS = "∑∏∫√≤≥≠≈∈∀∃∂∇⊗⊕±×÷αβγδεθλμνπρστφχψωΓΔΘΛΞΠΣΦΨΩ^_{}"


def math_share(line: Column) -> Column:
    """Share of a line's characters that are mathematical."""
    rest = F.translate(line, MATH_GLYPHS, "")
    return F.when(F.length(line) > 0, (F.length(line) - F.length(rest)) / F.length(line)).otherwise(0.0)


# JSON ------------------------------------------------------------------------------------------


def parse_json_reply(text: Column) -> Column:
    """The first readable of: the text, its fenced block, its outermost object, its outermost list;
    each also without trailing commas. Null if none is readable."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    outer = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    items = F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))
    tries = []
    for c in (text, fenced, outer, items):
        tries += [F.try_parse_json(c), F.try_parse_json(F.regexp_replace(c, r",\s*([}\]])", "$1"))]
    return F.coalesce(*tries)


# TeX -------------------------------------------------------------------------------------------

_INLINE = [
    (r"\\(?:emph|textbf|textit|texttt|textsc|underline|mathrm)\{([^{}]*)\}", "$1"),
    (r"\\(?:emph|textbf|textit|texttt|textsc|underline|mathrm)\{([^{}]*)\}", "$1"),
    (r"\\(?:emph|textbf|textit|texttt|textsc|underline|mathrm)\{([^{}]*)\}", "$1"),
    (r"\\cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^,{}]+)[^{}]*\}", "[$1]"),
    (r"\\(?:ref|eqref|autoref|cref|Cref|label)\{[^{}]*\}", ""),
    (r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", ""),
    (r"\$([^$]*)\$", "$1"),
    (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", ""),
    (r"(?<!\\)[{}]", ""),
    (r"\\([_%&{}$#])", "$1"),
    ("~", " "),
]


def tex_comments(source: Column) -> Column:
    """Comments are cut where a percent sign is not escaped."""
    return F.regexp_replace(source, r"(?m)(?<!\\)%.*$", "")


def tex_plain(text: Column) -> Column:
    """Inline TeX as plain text: markup unwrapped, citations as ``[key]``, references dropped, escapes
    resolved last."""
    return F.trim(reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), _INLINE, text))
