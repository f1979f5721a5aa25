"""Quality classifier over random-indexing word vectors.

Each word has an index vector, random, sparse and known from its hash alone.  The
context vector of a word sums the index vectors of its neighbours over the whole
corpus; sums are made per task and added natively.  The most frequent words
(exact counts, at most ``head`` of them) have context vectors of their own, rarer
ones share those of ``BUCKETS`` groups by hash.  A word's shape (letter case,
digits, marks) has an index vector as well.  A document is the mean of its
words' vectors, and a two-layer network in numpy, whose temperature is set on
labelled rows that it didn't train on, gives the probability of label 1.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, hold, id_crc, raw
from .lm import TEXT_END, frequent, word_counts

#: Words with vectors of their own, groups of rarer words, shapes, numbers in a vector.
HEAD, BUCKETS, SHAPES, DIM = 32_768, 1024, 256, 64
#: Index vectors that words draw theirs from by hash.
DRAWS = 1 << 16
#: Labelled rows that the network is fitted on, at the most: those with the smallest hash of their id.
SAMPLE = 20_000


def index_vectors(n: int, dim: int = DIM, filled: int = 8, seed: int = 17) -> np.ndarray:
    """Sparse ternary vectors."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, dim), np.int8)
    at = np.argsort(rng.random((n, dim)), axis=1)[:, :filled]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int8), (n, filled)), axis=1)
    return out


_DRAWN: dict[int, np.ndarray] = {}


def drawn() -> np.ndarray:
    if not _DRAWN:
        _DRAWN[0] = index_vectors(DRAWS)
    return _DRAWN[0]


_RUNS = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"))


class Words(dict):
    """Word -> (row of its vector, its index vector, its shape) as one number; kept words are dropped when there are many."""

    def __init__(self, head: dict[bytes, int]):
        self.head = head

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        shape, low = word, word.lower()
        for run, mark in _RUNS:
            shape = run.sub(mark, shape)
        crc = zlib.crc32(low)
        at = self.head.get(low, len(self.head) + crc % BUCKETS)
        self[word] = code = (at * DRAWS + (crc >> 10) % DRAWS) * SHAPES + zlib.crc32(shape) % SHAPES
        return code


@dataclass
class Head:
    """Words with vectors of their own, and how a worker finds the codes of any."""

    index: dict[bytes, int]

    def words(self) -> Words:
        if not hasattr(self, "_words"):
            self._words = Words(self.index)
        hold("classifier", self._words)
        return self._words

    @property
    def rows(self) -> int:
        return len(self.index) + BUCKETS


def _codes(texts: list[bytes], head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, index vectors and shapes of the words of texts laid end to end, and the texts' lengths."""
    found = [t.split() for t in texts]
    get = head.words().__getitem__
    code = np.array([get(w) for x in found for w in x], np.int64)
    return code // (SHAPES * DRAWS), code // SHAPES % DRAWS, code % SHAPES, np.array([len(x) for x in found])


def _chunks(batches, size: int = 1 << 20):
    for b in batches:
        texts, at = raw(b, "text"), 0
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and n < size:
                n += len(texts[end])
                end += 1
            yield b.slice(at, end - at), texts[at:end]
            at = end


def _add(sums: np.ndarray, index: np.ndarray, near: np.ndarray, most: int) -> None:
    """Add rows of small numbers (of -most to most) to those of ``sums`` that the index names.

    Four numbers add up in a word at a time, 16 bits each, over up to 4096 rows.
    """
    order = np.argsort(index, kind="stable")
    low = index[order]
    new = np.concatenate(([True], low[1:] != low[:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(len(low)), 0))
    at = np.flatnonzero((np.arange(len(low)) - start) % 4096 == 0)
    lanes = (near + np.int8(most)).astype(np.uint16).view(np.uint64)[order]
    size = np.diff(np.append(at, len(low)))
    got = np.add.reduceat(lanes, at, axis=0).view(np.uint16).astype(np.int64) - most * size[:, None]
    first = new[at]
    sums[low[at[first]]] += got[first]
    for row, more in zip(low[at[~first]].tolist(), got[~first]):
        sums[row] += more


def _contexts(batches, head, window: int):
    """A task's sums of neighbours' index vectors, a row for each word or group that occurs."""
    sums = None
    for _, texts in _chunks(batches):
        at, index, _, lengths = _codes(texts, head.value)
        if not len(at):
            continue
        doc, own = np.repeat(np.arange(len(lengths)), lengths), drawn()[index]
        near = np.zeros(own.shape, np.int8)
        for step in range(1, window + 1):
            near[step:] += own[:-step]
            near[:-step] += own[step:]
            # words of different texts are no neighbours
            apart = np.flatnonzero(doc[step:] != doc[:-step])
            near[apart + step] -= own[apart]
            near[apart] -= own[apart + step]
        if sums is None:
            sums = np.zeros((head.value.rows, DIM), np.int64)
        _add(sums, at, near, 2 * window)
    if sums is not None:
        some = np.flatnonzero(sums.any(axis=1))
        for k in range(0, len(some), 4096):
            part = sums[some[k : k + 4096]]
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 4096].astype(np.int32)), *[pa.array(c) for c in part.T.copy()]], ["row", *[f"v{i}" for i in range(DIM)]])


def word_vectors(texts: DataFrame, head: int = HEAD, window: int = 2) -> tuple[Head, np.ndarray]:
    """The words with vectors of their own, and the context vectors of all rows at unit length. Sums are of integers, so exact."""
    rows, _, _ = frequent(word_counts(texts).where(F.col("word") != F.lit(TEXT_END)), head)
    known = Head({w: i for i, w in enumerate(rows["word"])})
    shared = texts.sparkSession.sparkContext.broadcast(known)
    names = [f"v{i}" for i in range(DIM)]
    runs = texts.select("text").mapInArrow(partial(_contexts, head=shared, window=window), "row int, " + ", ".join(f"{n} long" for n in names))
    # the driver has one copy of the sums, by column, and of the vectors
    got = runs.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    context, row = np.zeros((known.rows, DIM), np.float32), got.column("row").to_numpy()
    for i, n in enumerate(names):
        context[row, i] = got.column(n).to_numpy().astype(np.float32)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return known, context


def pooled(texts: list[bytes], head: Head, vectors: np.ndarray) -> np.ndarray:
    """A row per text: mean of its words' context and index vectors, of their shapes' vectors, both norms, log of the length."""
    at, index, shape, lengths = _codes(texts, head)
    doc, n = np.repeat(np.arange(len(lengths)), lengths), np.maximum(lengths, 1)[:, None]
    words, start = np.zeros((len(lengths), DIM), np.float32), 0
    for k, size in enumerate(lengths.tolist()):
        for s in range(start, start + size, 1 << 16):
            e = min(s + (1 << 16), start + size)
            words[k] += np.ones(e - s, np.float32) @ (vectors[at[s:e]] + drawn()[index[s:e]] * np.float32(8**-0.5))
        start += size
    bag = np.bincount(doc * SHAPES + shape, minlength=len(lengths) * SHAPES).reshape(len(lengths), SHAPES).astype(np.float32)
    out = [words / n, bag @ (index_vectors(SHAPES, seed=29) / np.sqrt(8)) / n]
    norms = [np.linalg.norm(x, axis=1, keepdims=True) for x in out]
    return np.concatenate([*out, *norms, np.log1p(lengths)[:, None] / 10], axis=1).astype(np.float32)


class Network:
    """Two layers with a calibrated temperature."""

    def __init__(self, width: int, hidden: int = 32, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = np.zeros(width), np.ones(width), 1.0
        self.parts = [rng.standard_normal((width, hidden)) * np.sqrt(2 / width), np.zeros(hidden), rng.standard_normal(hidden) * np.sqrt(1 / hidden), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.parts
        return np.maximum((x - self.mean) / self.scale @ a + b, 0) @ c + d[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 9) -> None:
        """Adam on the log loss."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z, rng = x - self.mean, np.random.default_rng(seed)
        z /= self.scale
        m, v, t = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for at in range(0, len(z), batch):
                i = order[at : at + batch]
                a, b, c, d = self.parts
                h = np.maximum(z[i] @ a + b, 0)
                e = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30))) - y[i]) / len(i)
                back = np.outer(e, c) * (h > 0)
                t += 1
                for k, g in enumerate((z[i].T @ back + decay * a, back.sum(axis=0), h.T @ e + decay * c, np.array([e.sum()]))):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.parts[k] = self.parts[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature, of a grid, with the least log loss."""
        logit = self.logits(x)
        loss = lambda t: float(np.mean(np.logaddexp(0, -np.where(y > 0, 1, -1) * logit / t)))
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)


def _featured(batches, head, vectors):
    for b, texts in _chunks(batches, 1 << 19):
        x = pooled(texts, head.value, vectors.value)
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("y")), b.column(b.schema.get_field_index("k")), pa.array(list(x), pa.list_(pa.float32()))], ["y", "k", "x"])


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, sample: int = SAMPLE):
    """Word vectors from all texts (head and vectors as broadcasts), and a network from labelled rows whose id's CRC-32 isn't divisible by ``mod``.

    Rows with a null label or id don't count, of several labels of an id the
    mean decides, of several texts of an id the one with the least features, and a
    single class of labels gives a network that is sure of it.  The temperature is
    set on every eighth row, which the network isn't fitted on; of fewer than 16
    rows, on those that it is fitted on.
    """
    sc = docs.sparkSession.sparkContext
    known, context = word_vectors(docs)
    head, vectors = sc.broadcast(known), sc.broadcast(context)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(id_crc(F.col("doc_id")) % mod != 0)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers, so small enough to send to every task; one row of each id comes back
    texts = docs.join(F.broadcast(known), "doc_id").select("y", F.col("doc_id").alias("k"), "text")
    rows = texts.mapInArrow(partial(_featured, head=head, vectors=vectors), f"y int, k {docs.schema['doc_id'].dataType.simpleString()}, x array<float>")
    got = rows.groupBy("k").agg(F.min("x").alias("x"), F.min("y").alias("y")).toArrow()
    net = Network(2 * DIM + 3)
    if len(got):
        rows = got.select(["k", "y"]).to_pandas().sort_values("k")
        rows = rows.iloc[np.argsort([zlib.crc32(str(k).encode()) for k in rows["k"]], kind="stable")]
        # numbers of all rows as one array: as lists they'd take several times the memory
        x, y = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(got), -1)[rows.index].astype(float), rows["y"].to_numpy(float)
        del got
        aside = np.arange(len(x)) % 8 == 0 if len(x) >= 16 else np.zeros(len(x), bool)
        net.fit(x[~aside], y[~aside])
        check = aside if aside.any() else ~aside
        net.calibrate(x[check], y[check])
    return head, vectors, net


def _scores(batches, head, vectors, net: Network, names: list[str]):
    for b, texts in _chunks(batches, 1 << 19):
        p = net.probability(pooled(texts, head.value, vectors.value))
        yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in names], pa.array(p)], [*names, "__score"])


def score(docs: DataFrame, labels: DataFrame, columns: list[str], mod: int = 5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The wanted columns of all documents, with ``__score``, the probability of label 1.

    Null texts count as empty and get a score like any; repeated rows get equal
    scores; texts are scored whole, long ones too; ties in frequency go to the
    smaller word; an empty table gives no rows.  Of the wanted columns' names only
    ``__score`` is reserved; other columns are not read, so their names may clash.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    head, vectors, net = fit(plain, labels, mod, sample)
    given_back()  # what the driver needed for the fit
    # renamed by place, so that an input column may have any name
    columns = list(columns)
    kept = [f"c{k}" for k in range(len(columns))]
    fields = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, columns))
    read = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(kept, columns)], F.col(text_col).alias("text"))
    out = read.mapInArrow(partial(_scores, head=head, vectors=vectors, net=net, names=kept), f"{fields}, __score double")
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, columns)], "__score")
