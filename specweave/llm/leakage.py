"""Problem 7: passages of evaluation items inside corpus documents.

Size-partitioned MinHash containment search. Whole-document containment cannot find 13 words of an
item of 170 in a document of 3,000, so the sets that are searched are *passages*: every run of 13
words of an item, or the whole of an item of fewer words. Items are partitioned by passage size;
in a partition both sides have sets of the same size, where containment 1 is Jaccard similarity 1,
and one band of ``ROWS`` min-hashes over the five-word shingles (shorter ones in items of under five
words) has no false negative. The signature of a document's window is the sliding minimum over its
shingles' hashes, for all windows of a batch at once. Signatures that no item has are dropped in
the scan by a Bloom filter of bounded size; the rest are joined on the signature and verified by
comparing the words themselves; the passages are broadcast while they are small, so that no passage,
however many documents hold it, gathers them in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.functions.arrowtext import alnum_table, codepoints, fold_table, mix64, run_hashes, slices, spread_case, to_strings, word_runs
from specweave.session import cut, scan_width, schema_plus

PASSAGE_WORDS = 13
SHINGLE_WORDS = 5
ROWS = 2
#: The Bloom filter has 16 bits a signature, up to this many bits (32 MB); beyond, it lets more
#: windows through and the join drops them: only the shuffle grows.
BLOOM_BITS = 1 << 28
#: Passages of up to so many bytes go to every executor; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20
_WORD_BASE, _SHINGLE_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_SALTS = (0x165667B19E3779F9, 0x27D4EB2F165667C5)


class Words:
    """The words of a slice of texts: maximal runs of letters or digits, letter case folded."""

    def __init__(self, col: pa.Array):
        cps, offs = codepoints(col)
        self.rows = len(offs) - 1
        self.start, self.end = word_runs(alnum_table()[cps].astype(bool), offs)
        self.row = np.searchsorted(offs, self.start, "right") - 1
        cps, moved = spread_case(cps)
        if moved is not None:
            self.start, self.end = moved[self.start], moved[self.end]
        self.cps = fold_table()[cps]
        self.hash = run_hashes(mix64(self.cps.astype(np.uint64) + np.uint64(1)), self.start, self.end, _WORD_BASE)

    def signatures(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and signature of each window of ``size`` words within one text."""
        n = self.start.size - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        k = min(SHINGLE_WORDS, size)
        m = self.start.size - k + 1
        shingle = np.zeros(m, np.uint64)
        for j in range(k):
            shingle = shingle * np.uint64(_SHINGLE_BASE) + self.hash[j : j + m]
        sig = np.full(n, size, np.uint64)
        for salt in _SALTS[:ROWS]:
            h = mix64(shingle ^ np.uint64(salt))
            low, span, want = h, 1, size - k + 1
            while span < want:  # sliding minimum by doubling
                step = min(span, want - span)
                low = np.minimum(low[:-step], low[step:])
                span += step
            sig = mix64(sig * np.uint64(_SHINGLE_BASE) + low[:n])
        first = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return first, sig[first]

    def passages(self, first: np.ndarray, size: int) -> pa.Array:
        """The words of the windows, each followed by a blank, as strings."""
        if first.size == 0:
            return pa.array([], pa.string())
        w = (first[:, None] + np.arange(size)).ravel()
        lens = self.end[w] - self.start[w] + 1
        stop = np.cumsum(lens)
        src = np.arange(int(stop[-1])) + np.repeat(self.start[w] - (stop - lens), lens)
        chars = self.cps[np.minimum(src, self.cps.size - 1)]
        chars[stop - 1] = 32
        return to_strings(chars, np.concatenate([[0], stop[size - 1 :: size]]))


def passage_sizes(longest: int = PASSAGE_WORDS) -> range:
    return range(1, longest + 1)


def item_passages(items: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """``(id_col, size, sig, passage)``: the passages of each item with their signatures."""
    schema = schema_plus(items.select(id_col), "size int, sig bigint, passage string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, text_col):
                w = Words(batch.column(1))
                count = np.bincount(w.row, minlength=w.rows)
                for size in passage_sizes(words):
                    first, sig = w.signatures(size)
                    if size < words:
                        keep = count[w.row[first]] == size
                        first, sig = first[keep], sig[keep]
                    if first.size:
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(w.row[first])), pa.array(np.full(first.size, size, np.int32)), pa.array(sig.view(np.int64)), w.passages(first, size)],
                            [id_col, "size", "sig", "passage"],
                        )

    return items.select(id_col, text_col).mapInArrow(run, schema)


class Bloom:
    """A Bloom filter over 64-bit signatures; its size is bounded, see ``BLOOM_BITS``."""

    def __init__(self, n: int):
        self.bits = min(BLOOM_BITS, 1 << max(16, (16 * max(n, 1) - 1).bit_length()))
        self.table = np.zeros(self.bits >> 3, np.uint8)

    def _places(self, sig: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(3):
            yield (mix64(sig + np.uint64(k)) & np.uint64(self.bits - 1)).astype(np.int64)

    def add(self, sig: np.ndarray) -> None:
        for p in self._places(sig):
            np.bitwise_or.at(self.table, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, sig: np.ndarray) -> np.ndarray:
        live = np.arange(sig.size)
        for p in self._places(sig):
            p = p[live]
            live = live[(self.table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
        return live


def bloom_of(sigs: DataFrame) -> Bloom:
    """The filter of a column of signatures: filled by the executors, united one partition at a time."""
    whole = Bloom(sigs.count())
    bits = whole.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom.__new__(Bloom)
        own.bits, own.table = bits, np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            own.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([own.table.tobytes()], pa.binary())], ["bits"])

    for row in sigs.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        whole.table |= np.frombuffer(row["bits"], np.uint8)
    return whole


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """``(doc_id, item_id)``, once each: documents with ``words`` consecutive words of an item, or
    with all words of a shorter item in a row.

    A word is a maximal run of letters or digits; case and what stands between words do not count.
    Null and empty texts, and items without a word, are in no pair; equal items each get their
    pairs; repeated rows change nothing; other columns are not read; texts are read whole.
    """
    spark = docs.sparkSession
    passages = cut(item_passages(items, item_id, text_col, words).distinct(), "passages")
    sizes = sorted(r[0] for r in passages.select("size").distinct().collect())  # at most `words` of them
    bloom = bloom_of(passages.select("sig"))
    shared = spark.sparkContext.broadcast((bloom.bits, bloom.table))
    schema = schema_plus(docs.select(doc_id), "size int, sig bigint, passage string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bloom.__new__(Bloom)
        known.bits, known.table = shared.value
        for big in batches:
            for batch in slices(big, text_col):
                w = Words(batch.column(1))
                for size in sizes:
                    first, sig = w.signatures(size)
                    live = known.has(sig)
                    if live.size == 0:
                        continue
                    first, sig = first[live], sig[live]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(w.row[first])), pa.array(np.full(first.size, size, np.int32)), pa.array(sig.view(np.int64)), w.passages(first, size)],
                        [doc_id, "size", "sig", "passage"],
                    )

    found = scan_width(docs.select(doc_id, text_col)).mapInArrow(run, schema)
    size = passages.select(F.sum(F.octet_length("passage") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        passages = F.broadcast(passages)  # of a measured size: a passage of most documents meets no single task
    else:
        found = found.distinct()  # repeats of a passage in a document are dropped before they are sent
    return found.join(passages, ["size", "sig", "passage"]).select(doc_id, item_id).distinct()
