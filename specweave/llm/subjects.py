"""Problem 8: the subjects of each document.

A sentence is the average of its words' vectors, a word's vector the average of hashed embeddings of
the word and of its subwords (letters in threes to fives, ideographs in ones to threes), and each
subject has a logistic output of its own. Labels are given for documents, not sentences: at first
every sentence of a document counts for all its labels, then only those that the model so far finds
to speak of the label. Every step computes gradients on the partitions of the training table, adds
them up and takes one Adam step; then all documents are scored sentence by sentence. A sentence
counts for the subject that fits it best in the sense of the text, that is, weighed by what the
other sentences speak of, and for every other one that is sure when so weighed; a subject is found
if at least ``SENTENCES`` sentences count for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.functions.arrowtext import alnum_table, char_table, codepoints, fold_table, slices, to_strings, word_runs
from specweave.llm.lookform import look_form
from specweave.session import cut, scan_width, schema_plus

BUCKETS, DIM = 1 << 16, 16
#: The model is fitted on at most so many labelled documents, those of the smallest hash of the id.
MOST_LABELLED = 20_000
#: Labelled documents in a partition of the training table, and ranges in which gradients are added.
PER_PART, RANGES = 1500, 4
NAIVE_STEPS, REFINED_STEPS = 20, 24
RATE, DECAY, SCALE = 0.1, 1e-5, 6.0
SENTENCES = 2
SEEN = 0.4
SURE = 0.3
#: Of a subject that more of the sentences are labelled with, a sentence without anything to do with it
#: gets an output near that share; the first model's outputs are taken down to those of this share.
USUAL_SHARE = 0.2
#: Fewer words are a heading or a name, not a sentence (runs of ideographs are not counted in words).
LEAST_WORDS = 4
MEMO = 1 << 18


def _letter(ch: str) -> int:
    return ch.isalpha()


class Sentences:
    """Words of a slice of texts by sentence: distinct ``words``, ``word`` (index of each token),
    ``sentence`` (of each token, 0 to n-1, none empty) and ``row`` (of each sentence)."""

    def __init__(self, col: pa.Array):
        cps, offs = codepoints(col)
        n_rows = len(offs) - 1
        cps, offs = _mended(cps, offs)
        cps, offs = look_form(cps, offs)
        low = fold_table()[cps]
        start, end = word_runs(alnum_table()[low].astype(bool), offs)
        letters = np.concatenate([[0], np.cumsum(char_table(_letter)[low])])
        pure = letters[end] - letters[start] == end - start
        start, end = start[pure], end[pure]
        space = np.ones(low.size + 1, bool)
        space[:-1] = low == 32
        stop = ((low == 46) | (low == 33) | (low == 63) | (low == 59)) & space[1:] | (low == 0x3002) | (low == 0xFF01) | (low == 0xFF1F)
        breaks = np.zeros(low.size + 1, np.int64)
        breaks[1:] = stop
        np.add.at(breaks, offs[1:-1], 1)
        raw = np.cumsum(breaks)[start]
        self.n_rows = n_rows
        row = np.searchsorted(offs, start, "right") - 1
        if raw.size:
            own, size = _numbered(raw)
            wide = np.zeros(size.size, bool)
            wide[own[low[start] >= 0x2E80]] = True
            full = (wide | (size >= LEAST_WORDS))[own]
            raw, row, start, end = raw[full], row[full], start[full], end[full]
        self.sentence, size = _numbered(raw)
        self.row = np.zeros(size.size, np.int64)
        self.row[self.sentence] = row
        if start.size:
            lens = end - start
            stops = np.cumsum(lens)
            src = np.arange(int(stops[-1])) + np.repeat(start - (stops - lens), lens)
            coded = to_strings(low[src], np.concatenate([[0], stops])).dictionary_encode()
            self.words, self.word = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        else:
            self.words, self.word = [], np.empty(0, np.int64)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys numbered from 0, and how often each occurs."""
    own = np.zeros(keys.size, np.int64)
    own[1:] = np.cumsum(keys[1:] != keys[:-1])
    return own, np.bincount(own) if keys.size else own


def _mended(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words broken at a line's end put together; blank lines made ends of sentences."""
    if cps.size < 3:
        return cps, offs
    cps = cps.copy()
    letter = char_table(_letter)
    line = cps == 10
    pair = np.flatnonzero(line[:-1] & line[1:])
    cps[pair] = 46
    hyphen = np.flatnonzero(((cps[1:-2] == 45) | (cps[1:-2] == 0x2010) | (cps[1:-2] == 0xAD)) & (cps[2:-1] == 10) & (letter[cps[:-3]] == 1) & (letter[cps[3:]] == 1)) + 1
    gone = np.zeros(cps.size, bool)
    gone[hyphen] = gone[hyphen + 1] = True
    kept = np.concatenate([[0], np.cumsum(~gone)])
    return cps[~gone], kept[offs]


_memo: dict[str, np.ndarray] = {}


def word_features(word: str) -> np.ndarray:
    """Buckets of the word and its subwords."""
    if (got := _memo.get(word)) is None:
        import xxhash

        parts = ["=" + word]
        if ord(word[0]) >= 0x2E80:
            parts = [word[i : i + n] for n in (1, 2, 3) for i in range(len(word) - n + 1)]
        else:
            marked = f"<{word}>"
            parts += [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
        got = np.array([xxhash.xxh32_intdigest(p) & (BUCKETS - 1) for p in parts], np.int64)
        if len(_memo) < MEMO:
            _memo[word] = got
    return got


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words one behind the other, and how many each has."""
    feats = [word_features(w) for w in words]
    return np.concatenate(feats), np.array([f.size for f in feats])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by the index ``at``."""
    return np.stack([np.bincount(at, rows[:, j], n) for j in range(rows.shape[1])], axis=1).astype(np.float32)


class Model:
    """Embeddings, outputs and biases, as one flat vector to be summed and stepped."""

    def __init__(self, n_subjects: int, flat: np.ndarray | None = None):
        self.k = n_subjects
        if flat is None:
            rng = np.random.default_rng(20)
            # Outputs start on directions of their own, so that the first steps already part the words.
            out = rng.normal(0, 0.1, (n_subjects, DIM))
            out[np.arange(n_subjects), np.arange(n_subjects) % DIM] += SCALE
            flat = np.concatenate([rng.normal(0, 0.01, BUCKETS * DIM), out.ravel(), np.full(n_subjects, -2.0)]).astype(np.float32)
        self.flat = flat
        self.e = flat[: BUCKETS * DIM].reshape(BUCKETS, DIM)
        self.w = flat[BUCKETS * DIM : BUCKETS * DIM + n_subjects * DIM].reshape(n_subjects, DIM)
        self.b = flat[BUCKETS * DIM + n_subjects * DIM :]

    def forward(self, feats: np.ndarray, size: np.ndarray, word: np.ndarray, count: np.ndarray):
        """Logits of the sentences, and the words' vectors. ``feats`` and ``size`` are the buckets of the
        distinct words, ``word`` the index of each token, ``count`` the tokens of each sentence. The
        output of an average is the average of the words' outputs, so only those are spread over the
        tokens."""
        vec = np.add.reduceat(self.e[feats], np.cumsum(size) - size, axis=0) / size[:, None]
        z = np.add.reduceat((vec @ self.w.T)[word], np.cumsum(count) - count, axis=0) / count[:, None] + self.b
        return z, vec

    def logits(self, s: Sentences) -> np.ndarray:
        if not s.words or not s.row.size:
            return np.empty((0, self.k), np.float32)
        return self.forward(*features(s.words), s.word, np.bincount(s.sentence))[0]

    def gradient(self, feats: np.ndarray, size: np.ndarray, word: np.ndarray, count: np.ndarray, row: np.ndarray, labels: np.ndarray, teacher: Model | None, shift: np.ndarray) -> np.ndarray:
        """Summed gradient over the sentences of labelled documents."""
        z, vec = self.forward(feats, size, word, count)
        y = labels[row].astype(np.float32)
        if teacher is not None:
            # Of a label's sentences, those count in which the first model sees it, and none of the
            # document's other labels more clearly.
            mine = y * _sigmoid(teacher.forward(feats, size, word, count)[0] + shift)
            y = ((mine >= SEEN) & (mine >= 0.8 * mine.max(axis=1, keepdims=True))).astype(np.float32)
        d = _sigmoid(z) - y
        g = np.zeros_like(self.flat)
        out = Model(self.k, g)
        by_word = _scatter(word, np.repeat(d / count[:, None], count, axis=0), size.size)
        out.w[:] = by_word.T @ vec
        out.b[:] = d.sum(axis=0)
        out.e[:] = _scatter(feats, np.repeat((by_word @ self.w) / size[:, None], size, axis=0), BUCKETS)
        return g


_TRAINING = "feats array<int>, sizes array<int>, tokens array<int>, lengths array<int>, rows array<int>, labels array<boolean>"


def training_table(docs: DataFrame, labels: DataFrame, subjects: list[str], id_col: str, text_col: str) -> DataFrame:
    """Labelled documents cut into words and sentences, one row a slice of documents."""
    index = {s: i for i, s in enumerate(subjects)}
    named = labels.groupBy(id_col).agg(F.collect_set("subject").alias("subjects"))
    sample = cut(named.orderBy(F.xxhash64(id_col), id_col).limit(MOST_LABELLED), "sample")
    parts = max(1, -(-sample.count() // PER_PART))
    # At most MOST_LABELLED ids with their subjects: the corpus is filtered in its scan, not shuffled.
    rows = docs.select(id_col, text_col).where(f"{text_col} is not null").join(F.broadcast(sample), id_col).select(text_col, "subjects")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, text_col):
                s = Sentences(b.column(0))
                if not s.row.size:
                    continue
                y = np.zeros((b.num_rows, len(index)), bool)
                for r, names in enumerate(b.column(1).to_pylist()):
                    for x in names or ():
                        if x in index:
                            y[r, index[x]] = True
                feats, sizes = features(s.words)
                cols = [feats, sizes, s.word, np.bincount(s.sentence), s.row]
                arrays = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in cols]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([y.ravel()], pa.list_(pa.bool_()))], ["feats", "sizes", "tokens", "lengths", "rows", "labels"])

    return cut(rows.repartition(parts).mapInArrow(run, _TRAINING), "labelled")


def label_shares(table: DataFrame, n_subjects: int) -> np.ndarray:
    """The share of the sentences that stand in documents labelled with each subject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, n = np.zeros(n_subjects), 0
        for b in batches:
            for rows, y in zip(b.column(0), b.column(1), strict=True):
                rows = rows.values.to_numpy()
                hits += y.values.to_numpy(zero_copy_only=False).reshape(-1, n_subjects)[rows].sum(axis=0)
                n += rows.size
        yield pa.RecordBatch.from_arrays([pa.array([hits.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["hits", "n"])

    per = table.select("rows", "labels").mapInArrow(run, "hits array<double>, n bigint").where("n > 0")
    summed = per.select("n", F.posexplode("hits").alias("k", "hits")).groupBy("k").agg((F.sum("hits") / F.sum("n")).alias("share")).collect()
    out = np.zeros(n_subjects)
    for r in summed:
        out[r["k"]] = r["share"]
    return out


def train(table: DataFrame, n_subjects: int) -> Model:
    """Steps of Adam on gradients that the partitions compute and the executors add up; what comes to
    the driver in a step is one vector of the model's size."""
    sc = table.sparkSession.sparkContext
    model = Model(n_subjects)
    m, v = np.zeros_like(model.flat), np.zeros_like(model.flat)
    width = -(-model.flat.size // RANGES)
    schema = "part int, at binary, g binary, n bigint"

    shares = label_shares(table, n_subjects)
    shift = np.minimum(0, np.log(USUAL_SHARE / (1 - USUAL_SHARE)) - np.log((shares + 1e-6) / (1 - shares + 1e-6))).astype(np.float32)

    def gradients(shared, guide):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, teacher = Model(n_subjects, shared.value), guide and Model(n_subjects, guide.value)
            total, n = np.zeros_like(own.flat), 0
            for b in batches:
                for row in zip(*b.columns, strict=True):
                    feats, sizes, word, count, rows = (x.values.to_numpy() for x in row[:5])
                    y = row[5].values.to_numpy(zero_copy_only=False).reshape(-1, n_subjects)
                    total += own.gradient(feats, sizes, word, count, rows, y, teacher, shift)
                    n += count.size
            if n:
                for part in range(RANGES):
                    piece = total[part * width : (part + 1) * width]
                    at = np.flatnonzero(piece)
                    yield _piece(part, at, piece[at], n)

        return run

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for b in batches:
            for part, at, g, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                np.add.at(sums.setdefault(part, np.zeros(width, np.float32)), np.frombuffer(at, np.int32), np.frombuffer(g, np.float32))
                counts[part] = counts.get(part, 0) + n
        for part, total in sums.items():
            at = np.flatnonzero(total)
            yield _piece(part, at, total[at], counts[part])

    guide = None
    for step in range(1, NAIVE_STEPS + REFINED_STEPS + 1):
        shared = sc.broadcast(model.flat)
        if step == NAIVE_STEPS + 1:
            guide = sc.broadcast(model.flat)
        g, n = np.zeros(model.flat.size, np.float32), 0
        for r in table.mapInArrow(gradients(shared, guide), schema).repartition(RANGES, "part").mapInArrow(added, schema).collect():
            g[r["part"] * width + np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["g"], np.float32)
            n = r["n"]
        shared.destroy()
        if n == 0:
            break
        g = g / n + np.float32(DECAY) * model.flat
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        flat = model.flat - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model = Model(n_subjects, flat.astype(np.float32))
    return model


def _piece(part: int, at: np.ndarray, g: np.ndarray, n: int) -> pa.RecordBatch:
    cols = [pa.array([part], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([g.astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["part", "at", "g", "n"])


def sentence_subjects(p: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """How many sentences of each row count for each subject."""
    speaks = np.where(p >= 0.2, p, 0)
    whole = np.zeros((n_rows, p.shape[1]), np.float32)
    np.add.at(whole, row, speaks)
    others = whole[row] - speaks
    sense = 0.1 + others
    best = np.argmax(speaks * sense, axis=1)
    # The weight is 1 for the subject that the rest of the document speaks of most.
    counts = speaks * (sense / sense.max(axis=1, keepdims=True)) >= SURE
    sure = np.flatnonzero(speaks.max(axis=1) >= SURE)
    counts[sure, best[sure]] = True
    count = np.zeros((n_rows, p.shape[1]), np.int64)
    np.add.at(count, row, counts)
    return count


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, subject)`` for every document and each subject that several of its sentences deal
    with; labels only train the model, they are not copied into the result.

    Null, empty and wordless texts have no subject. A label of null says the document has none;
    labels of unknown documents or subjects are left out; repeated labels count once; without any
    usable label there is no result. Repeated documents give repeated rows; texts are read whole.
    """
    names = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().collect())
    schema = schema_plus(docs.select(id_col), "subject string")
    k = len(names)
    table = training_table(docs, labels, names, id_col, text_col) if k else None
    model = train(table, k) if k else None
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(model.flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(k, shared.value)
        for big in batches:
            for b in slices(big, text_col):
                s = Sentences(b.column(1))
                z = own.logits(s)
                count = sentence_subjects(_sigmoid(z), s.row, b.num_rows)
                r, c = np.nonzero(count >= SENTENCES)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array([names[i] for i in c], pa.string())], [id_col, "subject"])

    return scan_width(docs.select(id_col, text_col)).mapInArrow(run, schema)

