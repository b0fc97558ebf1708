"""TEI XML of converted papers as sections, paragraphs and formulas."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_NS = "{http://www.tei-c.org/ns/1.0}"
_SCHEMA = "paper_id string, section_index int, title string, kind string, item_index int, text string"


def _text(node: ET.Element | None) -> str:
    return re.sub(r"\s+", " ", "".join(node.itertext())).strip() if node is not None else ""


def _rows(paper: str, xml: str) -> Iterator[tuple]:
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return
    parts: list[tuple[str, list[tuple[str, str]]]] = []
    abstract = root.find(f".//{_NS}abstract")
    if _text(abstract):
        parts.append(("Abstract", [("paragraph", _text(p)) for p in abstract.iter(f"{_NS}p")] or [("paragraph", _text(abstract))]))
    for div in root.findall(f".//{_NS}body/{_NS}div"):
        head = div.find(f"{_NS}head")
        title = " ".join(x for x in ((head.get("n") or "") if head is not None else "", _text(head)) if x)
        items = [("equation" if c.tag == f"{_NS}formula" else "paragraph", _text(c)) for c in div if c.tag in (f"{_NS}p", f"{_NS}formula")]
        if any(t for _, t in items):
            parts.append((title, items))
    for i, (title, items) in enumerate(parts):
        for j, (kind, text) in enumerate((k, t) for k, t in items if t):
            yield paper, i, title or f"Section {i}", kind, j, text


def tei_items(docs: DataFrame) -> DataFrame:
    """Paragraphs and formulas by section from ``(paper_id, xml)``; what is no XML gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, x in zip(pdf["paper_id"], pdf["xml"], strict=True) if isinstance(x, str) for r in _rows(p, x)]
            yield pd.DataFrame(rows, columns=["paper_id", "section_index", "title", "kind", "item_index", "text"])

    return docs.select("paper_id", "xml").mapInPandas(run, _SCHEMA)
