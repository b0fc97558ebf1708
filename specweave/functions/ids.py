"""Identifiers that are pure functions of content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, spelt out so that every regular-expression dialect reads it alike.
WS = "[\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
UNIT_SEPARATOR = "\x1f"
#: Hex digits kept of a content hash: 64 bits, so that corpora of billions do not collide.
HEX = 16
SLUG_LENGTH = 40


def squeezed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def quote_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(squeezed(text), 256))


def content_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and the hash of the parts; null parts count as empty."""
    joined = F.concat_ws(UNIT_SEPARATOR, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, HEX))


def slugify(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(s, 1, SLUG_LENGTH), "_+$", ""), F.lit("")), F.lit("unnamed"))


def span_id(paper: Column, section: Column, paragraph: Column, offset: Column) -> Column:
    return F.format_string("%s#s%d.p%d.%d", paper, section, paragraph, offset)


_SPAN = r"^([^#]+)#s(\d+)\.p(\d+)\.(\d+)$"


def parse_span(span: Column) -> Column:
    """(paper, section, paragraph, offset); null for anything that is no span id."""
    part = lambda i: F.regexp_extract(span, _SPAN, i)
    number = lambda i: part(i).try_cast("bigint")
    fields = F.struct(part(1).alias("paper"), number(2).alias("section"), number(3).alias("paragraph"), number(4).alias("offset"))
    return F.when(span.rlike(_SPAN), fields)


def scope_id(span: Column) -> Column:
    """Paper and section of a span id; other text is its own scope."""
    got = F.regexp_extract(span, r"^([^#]+#s\d+)", 1)
    return F.when(got != "", got).otherwise(span)


def cluster_id(kind: Column, name: Column) -> Column:
    return F.concat(F.lit("cnc_"), F.substring(slugify(kind), 1, 4), F.lit("_"), slugify(name))


def component_id(name: Column) -> Column:
    return F.concat(F.lit("cmp_"), slugify(name))


def contradiction_id(cluster: Column, kind: Column, claim_ids: Column) -> Column:
    return content_id("ctr", cluster, kind, F.concat_ws(",", F.array_sort(claim_ids)))


def resolution_id(contradiction: Column) -> Column:
    return F.regexp_replace(contradiction, "^ctr_", "res_")


def gap_id(component: Column, field: Column) -> Column:
    return content_id("gap", F.coalesce(component, F.lit("global")), field)
