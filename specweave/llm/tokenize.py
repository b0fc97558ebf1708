"""Problem 6: token ids of every text by a public byte-level BPE vocabulary.

The merge procedure of BPE is replaced by a left-to-right search over tokens. Bytes are mapped to
Latin-1 characters, so that an Aho-Corasick automaton over the whole vocabulary finds, in one pass,
the longest token starting at each byte. From there the encoder goes on with the longest token
that is *compatible* with the token before it: BPE, run on the bytes of just these two, would yield
the same two. By the prefix property of BPE, a sequence whose adjacent pairs are all compatible is
the sequence that the merges yield, so the first one found is exact. On a dead end the position is
marked and the last token is shortened; every position is marked once at most and each token has a
bounded number of shorter prefixes, hence linear time also in very long unbroken texts. Pair
compatibility is memoised, and so are the ids of short pieces.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from specweave.session import scan_width, schema_plus

DEFAULT_DIR = "/opt/tokenizers"
DEFAULT_VOCAB = "byte_bpe_50k"
#: Pieces up to this many characters are memoised, up to so many of them in a worker.
MEMO_CHARS, MEMO_SIZE = 24, 400_000
#: Neighbouring tokens whose compatibility a worker remembers.
PAIRS_SIZE = 2_000_000


def _byte_chars() -> dict[str, int]:
    """The published byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    are shifted, in order, to 256 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeEncoder:
    """Exact ids of a piece of bytes for a list of merges."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        import ahocorasick

        self.vocab, self.text = vocab, {i: t for t, i in vocab.items()}
        # Merged in this order; single bytes come before all merges.
        self.order = {vocab[a + b]: k + 256 for k, (a, b) in reversed([*enumerate(merges)])}
        self.joined = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in reversed(merges)}
        self.reach = {*self.order} | {vocab[bytes([b])] for b in range(256)}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in self.reach:
                self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.whole = {t: i for t, i in vocab.items() if i in self.reach}
        self.memo: dict[str, list[int]] = {}

    def prefix_of(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if (got := self.shorter.get(token)) is None:
            b = self.text[token]
            got = next((self.whole[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.whole), -1)
            self.shorter[token] = got
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges, run on the bytes of both tokens, keep the border between them."""
        key = (left, right)
        if (got := self.compatible.get(key)) is None:
            got = self._fits(left, right)
            if len(self.compatible) < PAIRS_SIZE:
                self.compatible[key] = got
        return got

    def _fits(self, left: int, right: int) -> bool:
        # Walk back through the merges that formed the two tokens, the latest first. At each moment
        # the tokens facing each other at the border must not have a merge of an earlier turn than
        # the next one that touches either of them: it would have crossed the border.
        never = 1 << 60
        due = never
        order, parts, joined = self.order, self.parts, self.joined
        while True:
            both = joined.get((left, right))
            if both is not None and order[both] < due:
                return False
            a, b = order.get(left, -1), order.get(right, -1)
            if a < 0 and b < 0:
                return True
            # At equal turns the left one was merged first (merges run from the left), so the right
            # one is undone first, and a merge across the border of that same turn came before it.
            if a > b:
                due, left = a, parts[left][1]
            else:
                due, right = b + 1, parts[right][0]

    def encode_bytes(self, piece: bytes) -> list[int]:
        if (one := self.whole.get(piece)) is not None:
            return [one]
        n = len(piece)
        longest = [0] * n
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # later ends are longer
        size_of = {}
        text, fits, dead = self.text, self.fits, bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                if (size := size_of.get(token)) is None:
                    size = size_of[token] = len(text[token])
                if not dead[at + size] and (last < 0 or fits(last, token)):
                    break
                token = self.prefix_of(token)
            if token >= 0:
                out.append(token)
                at += size
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= size_of[token]
        return out

    def encode_piece(self, piece: str) -> list[int]:
        if (got := self.memo.get(piece)) is None:
            got = self.encode_bytes(piece.encode("utf-8"))
            if len(piece) <= MEMO_CHARS and len(self.memo) < MEMO_SIZE:
                self.memo[piece] = got
        return got


@lru_cache(maxsize=4)
def load_encoder(directory: str, name: str):
    """The encoder of the vocabulary file and its compiled split pattern; once in each worker."""
    import importlib.util

    import regex

    spec = importlib.util.spec_from_file_location("_public_tokenizers", f"{directory}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{directory}/{name}.json", encoding="utf-8") as f:
        model = json.load(f)["model"]
    chars = _byte_chars()
    as_bytes = lambda s: bytes(chars[c] for c in s)
    vocab = {as_bytes(t): i for t, i in model["vocab"].items() if all(c in chars for c in t)}
    merges = [tuple(as_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return MergeEncoder(vocab, merges), regex.compile(module.PATTERN)


def encode_text(text: str, directory: str = DEFAULT_DIR, name: str = DEFAULT_VOCAB) -> list[int]:
    encoder, split = load_encoder(directory, name)
    out: list[int] = []
    for m in split.finditer(text):
        out += encoder.encode_piece(m.group())
    return out


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str = DEFAULT_DIR, name: str = DEFAULT_VOCAB) -> DataFrame:
    """``(id_col, ids array<int>)`` for every row; null and empty texts give the empty list.

    Strings of special tokens in a text are ordinary text. A repeated row gives a repeated result,
    an empty table an empty one; other columns are not read. No shuffle: one pass over the scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = load_encoder(directory, name)
        memo, find, encode = encoder.memo, split.finditer, encoder.encode_piece
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                batch = big.slice(lo, 512)
                flat: list[int] = []
                offs = np.zeros(batch.num_rows + 1, np.int32)
                for r, text in enumerate(batch.column(1)):
                    if text := text.as_py():
                        for m in find(text):
                            piece = m.group()
                            flat += memo.get(piece) or encode(piece)
                    offs[r + 1] = len(flat)
                ids = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return scan_width(df.select(id_col, text_col)).mapInArrow(run, schema_plus(df.select(id_col), "ids array<int>"))
