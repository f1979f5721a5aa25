"""Scoring by a log-bilinear language model beside a smoothed unigram base.

Counts of all training words are exact and distributed.  The most frequent
words, cut at a power-of-two count so that at most ``head`` remain, travel to
the workers; rarer ones are joined to the documents that hold them by a
shuffle.  Every word has a class: half of the ``classes`` are the most frequent
words, one each, the other half collects all other words by a hash of their last
two bytes, as endings tell much about what may stand next.  The neural model predicts a class from the
classes of the two words before it: context vectors
add up to a query, whose product with the class vectors gives logits.  It is
trained in numpy by noise-contrastive estimation over all training documents:
in each pass each task runs over its own, and parameters are averaged with token
weights, by a sum in Spark; the next pass starts from the mean.  Scoring normalises exactly: log-partition values of
context pairs come from batched matrix products and are kept per worker.  Within
a class a word's share is its smoothed count, and each class of endings holds one
unknown word, so the probabilities of a context add up to one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, dealt_words, ends_of, hold, id_crc, raw

#: The token at each text's end; words hold no line end, so it is no word.
TEXT_END = b"\n"
SMOOTH = 0.1
#: CRC-32 of one byte and of two.
CRC = np.array([zlib.crc32(bytes([a])) for a in range(256)], np.int64), np.array([[zlib.crc32(bytes([a, b])) for b in range(256)] for a in range(256)], np.int64)
#: Log-partition values of contexts, by worker.
_PARTITION: dict = {}


def tokens(text: bytes) -> list[bytes]:
    found = text.lower().split()
    found.append(TEXT_END)
    return found


def _counts(batches, flush: int = 250_000):
    seen: Counter = Counter()

    def out():
        got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        seen.clear()
        return got

    for b in batches:
        for t in raw(b, "text"):
            seen.update(tokens(t))
            if len(seen) > flush:
                yield out()
    if seen:
        yield out()


@dataclass
class Head:
    """Frequent words in rank order, the first ``plain`` of them classes of their own, and the smoothed counts of each class."""

    index: dict
    counts: np.ndarray
    plain: int
    mass: np.ndarray
    total: int
    distinct: int

    @property
    def classes(self) -> int:
        return len(self.mass)

    def unigram(self) -> np.ndarray:
        return self.mass / self.mass.sum()

    def codes(self) -> Codes:
        """The codes of words, one by one."""
        return Codes(self)

    def coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ranks, -1 for words out of the head, and classes of a binary array of words."""
        if not hasattr(self, "_words"):
            self._words = pa.array(list(self.index), pa.binary())
        rank = pc.fill_null(pc.index_in(words, value_set=self._words), -1).to_numpy().astype(np.int64)
        data, ends = ends_of(words)
        last, size = data[ends[1:] - 1], np.diff(ends)
        crc = np.where(size > 1, CRC[1][data[np.maximum(ends[1:] - 2, 0)], last], CRC[0][last])
        return rank, np.where((rank >= 0) & (rank < self.plain), rank, self.plain + crc % (self.classes - self.plain))

    @property
    def end(self) -> int:
        return self.codes()[TEXT_END] % self.classes


class Codes(dict):
    """Word -> (rank + 1) * classes + class, rank -1 for words out of the head."""

    def __init__(self, head: Head):
        self.index, self.plain, self.classes = head.index, head.plain, head.classes

    def __missing__(self, word: bytes) -> int:
        rank = self.index.get(word, -1)
        cls = rank if 0 <= rank < self.plain else self.plain + zlib.crc32(word[-2:]) % (self.classes - self.plain)
        self[word] = code = (rank + 1) * self.classes + cls
        return code


@dataclass
class Model:
    """Context vectors by position, class vectors and biases."""

    first: np.ndarray
    second: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def rows(self) -> np.ndarray:
        return np.concatenate((self.first, self.second, self.out, np.pad(self.bias[:, None], ((0, 0), (0, self.out.shape[1] - 1)))))

    @staticmethod
    def of(rows: np.ndarray) -> Model:
        a, b, c, d = np.split(rows.astype(np.float32), 4)
        return Model(a, b, c, np.ascontiguousarray(d[:, 0]))

    def query(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.first[one] + self.second[two]


def initial(head: Head, dim: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    drawn = lambda size: (rng.standard_normal((head.classes, dim)) * size).astype(np.float32)
    return Model(drawn(0.3), drawn(0.3), drawn(0.05), np.log(head.unigram()).astype(np.float32))


def _summed(low: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices that occur in a sorted list and the sums of their gradients."""
    at = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    if grad.ndim > 1 and grad.shape[1] % 2 == 0:
        # two numbers at a time
        return low[at], np.add.reduceat(grad.view(np.complex64), at, axis=0).view(np.float32)
    return low[at], np.add.reduceat(grad, at, axis=0)


def _logistic(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def train(model: Model, streams, noise_p: np.ndarray, noise: int = 64, batch: int = 1024, rate: float = 0.1, seed: int = 3) -> int:
    """One pass of noise-contrastive estimation with adaptive steps, in place; the tokens seen."""
    rng, k = np.random.default_rng(seed), model.out.shape[0]
    small = np.min_scalar_type(2 * k)
    log_noise = np.log(noise_p * noise).astype(np.float32)
    context = np.concatenate((model.first, model.second))
    past = [np.full_like(x, 1e-6) for x in (context, model.out, model.bias)]

    def step(x: np.ndarray, seen: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        now = seen.take(at, axis=0)
        now += grad * grad
        seen[at] = now
        np.sqrt(now, out=now)
        np.divide(grad, now, out=now)
        now *= np.float32(rate)
        now += x.take(at, axis=0)
        x[at] = now

    total, share = 0, np.cumsum(noise_p)
    share /= share[-1]
    for one, two, word in streams:
        drawn = np.searchsorted(share, rng.random((len(word) // batch + 1, noise)), side="right")
        both = np.stack((one, two + k))
        for at in range(0, len(word), batch):
            ab, w = both[:, at : at + batch], word[at : at + batch]
            fake, n = drawn[at // batch], len(w)
            q, met, sham = context.take(ab[0], axis=0), model.out.take(w, axis=0), model.out.take(fake, axis=0)
            q += context.take(ab[1], axis=0)
            real = np.einsum("ij,ij->i", q, met) + model.bias[w] - log_noise[w]
            drawn_as = q @ sham.T + (model.bias[fake] - log_noise[fake])
            # what is left to learn of true words, and what noise is taken for, by the logistic function
            with np.errstate(over="ignore"):
                up, down = _logistic(-real), _logistic(drawn_as)
            up *= np.float32(1 / n)
            down *= np.float32(-1 / n)
            gq = up[:, None] * met + down @ sham
            go = np.concatenate((up[:, None] * q, down.T @ q))
            # short numbers are sorted by their digits
            index = ab.ravel().astype(small)
            order = np.argsort(index, kind="stable")
            step(context, past[0], *_summed(index[order], gq.take(order % n, axis=0)))
            index = np.concatenate((w, fake)).astype(small)
            order = np.argsort(index, kind="stable")
            step(model.out, past[1], *_summed(index[order], go.take(order, axis=0)))
            step(model.bias, past[2], *_summed(index[order], np.concatenate((up, down.sum(0)))[order]))
            total += n
    model.first[...], model.second[...] = context[:k], context[k:]
    return total


def _classed(texts: list[bytes], head: Head):
    """(words, each token's index in them, ranks with -1 for words out of the head, classes, classes one and two back, lengths) of texts laid end to end."""
    hold("lm", _PARTITION)
    words, index, size = dealt_words([t.lower() for t in texts])
    words, lengths = pa.concat_arrays([words, pa.array([TEXT_END], pa.binary())]), size + 1
    starts = np.cumsum(lengths) - lengths
    at = np.full(int(lengths.sum()), len(words) - 1)
    inner = np.ones(len(at), bool)
    inner[starts + size] = False
    at[inner] = index
    ranks, classes = head.coded(words)
    rank, cls, end = ranks[at], classes[at], classes[-1]
    one = np.concatenate(([end], cls[:-1]))
    two = np.concatenate(([end], one[:-1]))
    one[starts] = two[starts] = end
    longer = starts[lengths > 1] + 1
    two[longer] = end
    return words, at, rank, cls, one, two, lengths


def _chunks(batches, size: int = 1 << 21):
    for b in batches:
        texts, at = raw(b, "text"), 0
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and n < size:
                n += len(texts[end])
                end += 1
            yield b.slice(at, end - at), texts[at:end]
            at = end


def _trained(batches, head, start: np.ndarray, noise_p: np.ndarray):
    model = Model.of(start.copy())

    def streams():
        for _, texts in _chunks(batches):
            *_, cls, one, two, _ = _classed(texts, head.value)
            yield one, two, cls

    n = train(model, streams(), noise_p)
    if n:
        rows = model.rows().astype(np.float64) * n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), float(n))), *[pa.array(c) for c in rows.T.copy()]], ["row", "w", *[f"v{i}" for i in range(rows.shape[1])]])


def _partitions(model: Model, key: bytes, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Natural log of the normaliser of each context; known ones are kept by worker."""
    k = len(model.bias)
    if _PARTITION.get("key") != key:
        _PARTITION.update(key=key, log=np.full(k * k, np.nan, np.float32))
    log, at = _PARTITION["log"], one * k + two
    new = np.unique(at[np.isnan(log[at])])
    for i in range(0, len(new), 4096):
        x = new[i : i + 4096]
        logits = model.query(x // k, x % k) @ model.out.T + model.bias
        top = logits.max(axis=1)
        log[x] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
    return log[at]


def _scored(batches, head, rows: np.ndarray):
    h, model = head.value, Model.of(rows)
    key = xxhash.xxh3_128_digest(rows.tobytes())
    log_c, log_mass = np.log10(h.counts + SMOOTH), np.log10(h.mass)
    for b, texts in _chunks(batches):
        words, at, rank, cls, one, two, lengths = _classed(texts, h)
        logit = np.einsum("ij,ij->i", model.query(one, two), model.out[cls]) + model.bias[cls] - _partitions(model, key, one, two)
        known = rank >= 0
        count = np.where(known, log_c[np.maximum(rank, 0)] if len(log_c) else 0.0, 0.0)
        # a word's share of its class: the smoothed count (0 here, joined later, for words out of the head) by the class's
        inner = count - log_mass[cls] + logit.astype(np.float64) / math.log(10)
        starts = np.cumsum(lengths) - lengths
        total = lambda x: np.add.reduceat(x, starts)
        # each text's words out of the head and how often it has them
        sparse = np.flatnonzero(~known)
        owner = np.searchsorted(starts, sparse, side="right") - 1
        each, times = np.unique(owner * len(words) + at[sparse], return_counts=True)
        tail = pa.StructArray.from_arrays([words.take(pa.array(each % len(words))), pa.array(times, pa.int64())], ["word", "n"])
        stops = np.searchsorted(each, np.arange(len(texts) + 1) * len(words))
        uid = [xxhash.xxh3_128_digest(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("held_out")), pa.array(uid, pa.binary()), pa.array(lengths, pa.int64()),
                pa.array(total(known.astype(np.int64)), pa.int64()), pa.array(total(count)), pa.array(total(inner)),
                pa.ListArray.from_arrays(pa.array(stops, pa.int32()), tail),
            ],
            ["doc_id", "held_out", "uid", "n_tokens", "head_known", "head_base", "head_score", "tail"],
        )


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens of a table of texts."""
    return checkpointed(texts.select("text").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def frequent(counts: DataFrame, head: int) -> tuple[pd.DataFrame, int, int]:
    """The most frequent words in rank order, cut at a power-of-two count so that ``head`` at the most reach the driver; all tokens; all words."""
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    by = counts.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).toPandas().sort_values("level", ascending=False)
    fits = by[by["k"].cumsum() <= head]["level"]
    rows = counts.where(level >= int(fits.min())).toPandas() if len(fits) else counts.limit(0).toPandas()
    return rows.assign(word=rows["word"].map(bytes)).sort_values(["n", "word"], ascending=[False, True]), int(by["n"].sum()), int(by["k"].sum())


def learn_head(counts: DataFrame, head: int, classes: int) -> Head:
    """The frequent words of a (word, n) table and the counts of all classes."""
    rows, total, distinct = frequent(counts, head)
    words, n = list(rows["word"]), rows["n"].to_numpy(np.int64)
    plain = min(classes // 2, len(words))
    endings = classes // 2
    ending = (F.crc32(F.substring("word", -2, 2)) % endings).cast("int")
    mass = np.full(endings, SMOOTH)  # that of one unknown word
    for at, k, size in counts.groupBy(ending.alias("at")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect():
        mass[at] += size + SMOOTH * k
    for w, size in zip(words[:plain], n):
        mass[zlib.crc32(w[-2:]) % endings] -= size + SMOOTH
    return Head({w: i for i, w in enumerate(words)}, n, plain, np.concatenate((n[:plain] + SMOOTH, np.maximum(mass, SMOOTH))), total, distinct)


def score(docs: DataFrame, head: int = 131_072, classes: int = 1024, dim: int = 24, passes: int = 2, seed: int = 1, mod: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document.

    Training documents are those whose id's CRC-32 isn't divisible by ``mod``.
    Null texts count as empty (one end token); repeated rows train and score as
    often as they occur; with no training document every count is 0, the base
    knows a single unknown word and the model one for each ending; an empty table
    gives no rows.  Ties in frequency go to the smaller word.  Other columns are
    not read, so their names may clash.  Texts are scored whole: a text is one
    row of its worker, longer ones only fill it more.  ``classes`` and ``dim``
    bound what the model can tell, not the vocabulary: every word has a class.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (id_crc(F.col(id_col)) % mod == 0).alias("held_out"))
    training = rows.where(~F.col("held_out")).select("text")
    counts = word_counts(training)
    h = learn_head(counts, head, classes)
    shared = spark.sparkContext.broadcast(h)
    model, noise_p = initial(h, dim, seed).rows(), h.unigram()
    names = [f"v{i}" for i in range(dim)]
    for _ in range(passes):
        runs = training.mapInArrow(partial(_trained, head=shared, start=model, noise_p=noise_p), "row int, w double, " + ", ".join(f"{n} double" for n in names))
        mean = runs.groupBy("row").agg(*[(F.sum(n) / F.sum("w")).alias(n) for n in names]).toPandas().sort_values("row")
        model = mean[names].to_numpy() if len(mean) else model
    kind = docs.schema[id_col].dataType.simpleString()
    scored = checkpointed(
        rows.mapInArrow(
            partial(_scored, head=shared, rows=model.astype(np.float32)),
            f"doc_id {kind}, held_out boolean, uid binary, n_tokens long, head_known long, head_base double, head_score double, tail array<struct<word:binary,n:long>>",
        )
    )
    # rare words meet their counts; a text's copies add up alike, so sums are divided by their number
    rare = scored.select("uid", F.posexplode("tail").alias("at", "x")).select("uid", "at", "x.word", F.col("x.n").alias("times"))
    each = rare.join(counts, "word", "left").select("uid", F.when(F.col("at") == 0, 1).otherwise(0).alias("copies"), "times", F.coalesce("n", F.lit(0)).alias("c"))
    sums = each.groupBy("uid").agg(
        F.sum("copies").alias("copies"), F.sum(F.col("times") * F.log10(F.col("c") + SMOOTH)).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known")
    )
    tail_log, tail_known = (F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0)) for c in ("tail_log", "tail_known"))
    base = F.col("head_base") + tail_log - F.col("n_tokens") * math.log10(h.total + SMOOTH * (h.distinct + 1))
    return scored.join(sums, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.round(tail_known).cast("long")).alias("n_known"), F.lit(h.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("head_score") + tail_log).alias("score"),
    )
