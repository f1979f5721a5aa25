"""Removal of passages that repeat, by hashing units of words.

Where a unit ends is decided by the words around it alone, so that a passage is
cut alike wherever it stands.  Of the line ends, sentence ends and places before
a capitalised word after a lower-case one, those that come first by kind and hash
among their like within ``min_unit_words`` words are cuts.  Further than
``REACH`` words from any of them, a gap between words is a cut where its hash is
the least within that reach, so passages without marks are cut as well.  Units
are normalised (lower case, single spaces) and hashed; digests are counted
globally; the earliest occurrence by (document id, row, position) stays.  A later
occurrence is removed where it belongs to a run of repeated units of at least
``min_run_words`` words, so a short sentence that two texts share by chance
stays.  Removed spans keep their offsets in the original text.

A row is told by its id and a hash of id and text, so rows without an id and
different texts under one id have occurrences of their own.  Groups hold counts
and minima only, made before the shuffle; units meet the repeated digests, and
those that do meet the earliest occurrence, in plain equi-joins of written
tables, whose hot keys adaptive execution can split.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, raw, written

#: Where a unit may end: at a line end, after a sentence mark, or before a capitalised word after a lower-case one.
PIECE = re.compile(r"\n+|(?<=[.!?…])[^\S\n]+|(?<=[^\W\d_A-ZÀ-Þ])[^\S\n]+(?=[A-ZÀ-Þ][^\W\d_A-ZÀ-Þ])|(?<=,)[^\S\n]+(?=[A-ZÀ-Þ][^\W\d_A-ZÀ-Þ])")
#: Words on each side that a gap without a mark is compared with.
REACH = 3
#: Code points cut into units at a time, but for a longer text.
BLOCK = 1 << 19
#: Whether a code point is white space; the last entry stands for all beyond.
SPACES = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
NONE = np.uint64(2**64 - 1)
ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Word -> its hash; kept words are dropped when there are many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_HASHES = Hashes()


def least(keys: np.ndarray, reach: int) -> np.ndarray:
    """Whether each key is the least within ``reach`` places, the first one of equals."""
    n, out = len(keys), np.ones(len(keys), bool)
    for k in range(1, min(reach, n - 1) + 1):
        out[k:] &= keys[k:] < keys[:-k]
        out[:-k] &= keys[:-k] <= keys[k:]
    return out


def powers(n: int) -> np.ndarray:
    """Multipliers of the words of a unit by their place."""
    return np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n - 1, 0), np.uint64(0xD6E8FEB86659FD93)))))[:n]


def units(texts: list[str], min_words: int) -> tuple[np.ndarray, ...]:
    """(text, position, start, end, words, digest) of the units of some texts; the units of a text cover its words.

    The texts are laid end to end, with gaps between them that no cut takes.
    """
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate(([False], ~SPACES[np.minimum(points, len(SPACES) - 1)], [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64, np.int32, np.int64))
    hashes = np.fromiter(map(_HASHES.__getitem__, joined.lower().split()), np.uint64, len(starts))
    text_at = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
    owner = np.searchsorted(text_at, starts, side="right") - 1
    # a place for the gap after each word, and spare ones between texts, further apart than any comparison
    spare = max(REACH, min_words)
    place = np.arange(len(starts)) + spare * owner
    same = np.concatenate((owner[1:] == owner[:-1], [False]))
    keys = np.full(int(place[-1]) + 1, NONE)
    keys[place[:-1]] = np.where(same[:-1], ((hashes[:-1] * ODD) ^ hashes[1:]) >> np.uint64(2), NONE)
    kind = np.full(len(keys), 2, np.uint8)
    found = [(m.end(), joined[m.start()] != "\n") for m in PIECE.finditer(joined)]
    if found:
        end, mark = np.array(found).T
        at = np.searchsorted(starts, end) - 1
        good = at >= 0
        good[good] &= same[at[good]]
        np.minimum.at(kind, place[at[good]], mark[good].astype(np.uint8))
    marked = kind < 2
    near = marked.copy()
    for k in range(1, min(REACH, len(keys) - 1) + 1):
        near[k:] |= marked[:-k]
        near[:-k] |= marked[k:]
    ranked = np.where(marked, keys | kind.astype(np.uint64) << np.uint64(62), NONE)
    cut = np.where(marked, least(ranked, min_words - 1), least(keys, REACH) & ~near)[place]
    first = np.flatnonzero(np.concatenate(([True], cut[:-1] | ~same[:-1])))
    size = np.diff(np.append(first, len(starts)))
    within = np.arange(len(starts)) - np.repeat(first, size)
    digest = np.add.reduceat((hashes ^ hashes >> np.uint64(29)) * powers(int(size.max()))[within], first) + size.astype(np.uint64)
    digest = (digest ^ digest >> np.uint64(32)) * ODD
    text = owner[first]
    opens = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    pos = np.arange(len(first)) - np.repeat(opens, np.diff(np.append(opens, len(first))))
    return text, pos.astype(np.int32), starts[first] - text_at[text], ends[first + size - 1] - text_at[text], size.astype(np.int32), digest.view(np.int64)


def _blocks(texts: list[str]):
    """(first, last) of runs of texts that are cut together."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and n < BLOCK:
            n += len(texts[end])
            end += 1
        yield at, end
        at = end


def _units(batches, min_words: int):
    hold("substring", _HASHES)
    for b in batches:
        ids, rows = (b.column(b.schema.get_field_index(n)) for n in ("doc_id", "row"))
        texts = [t.decode("utf-8", "replace") for t in raw(b, "text")]
        for at, end in _blocks(texts):
            text, pos, _, _, n, digest = units(texts[at:end], min_words)
            of = pa.array(at + text)
            yield pa.RecordBatch.from_arrays([ids.take(of), rows.take(of), pa.array(pos), pa.array(n), pa.array(digest)], ["doc_id", "row", "pos", "n_words", "digest"])


def removed_units(repeated: list[tuple[int, int]], min_run: int) -> list[int]:
    """Positions to remove of the (position, words) of repeated units: runs with enough words."""
    out, run, size = [], [], 0
    for pos, n in [*sorted(repeated), (-1, 0)]:
        if run and pos != run[-1] + 1:
            if size >= min_run:
                out += run
            run, size = [], 0
        run.append(pos)
        size += n
    return out


def cleaned(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; lines that become empty go, and no word is glued to another."""
    out, last = [], 0
    for s, e in spans:
        out.append(text[last:s])
        last = e
    out.append(text[last:])
    kept = out[0]
    for x in out[1:]:
        if not kept or kept.endswith("\n"):
            x = x.lstrip()
        elif x.startswith("\n"):
            kept = kept.rstrip(" \t")
        elif kept[-1].isspace():
            x = x.lstrip(" \t")
        kept += x
    return kept


def _cleaned(batches, min_words: int, min_run: int, names: list[str]):
    hold("substring", _HASHES)
    for b in batches:
        old = b.column(b.schema.get_field_index("text")).to_pylist()
        marked = b.column(b.schema.get_field_index("__repeated")).to_pylist()
        gone = {k: p for k, x in enumerate(marked) if x and (p := removed_units([(u["pos"], u["n_words"]) for u in x], min_run))}
        new, total, removed, rows = list(old), [0] * len(old), [[] for _ in old], list(gone)
        texts = [old[k] for k in rows]
        for at, end in _blocks(texts):
            text, _, start, stop, n, _ = units(texts[at:end], min_words)
            first = np.searchsorted(text, np.arange(end - at))
            for k, row in enumerate(rows[at:end]):
                away = np.array(gone[row])
                opens = np.flatnonzero(np.concatenate(([True], np.diff(away) > 1)))
                lows = first[k] + away[opens]
                highs = first[k] + away[np.append(opens[1:], len(away)) - 1]
                spans = list(zip(start[lows].tolist(), stop[highs].tolist()))
                size = np.add.reduceat(n[first[k] + away], opens).tolist()
                new[row], total[row] = cleaned(old[row], spans), sum(size)
                removed[row] = [{"start": s, "length": e - s, "n_words": w} for (s, e), w in zip(spans, size)]
        cols = [pa.array(new, pa.string()) if n == "text" else b.column(b.schema.get_field_index(n)) for n in names]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("n_words", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, kind)], [*names, "removed_words", "removed"])


def remove_repeats(docs: DataFrame, min_unit_words: int = 4, min_run_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated passages removed, plus removed_words and removed
    (spans in code points of the original text).

    All input columns stay, the text is changed (input columns named
    removed_words or removed are replaced; the names ``__id``, ``__row``, ``__key``
    and ``__repeated`` are reserved).  A null text stays null; an empty one empty.
    Ids order the occurrences, null first; rows that share an id, or have none,
    go by a hash of their text.  Rows equal in id and text are one document and
    are cleaned alike, so what comes first in it stays in each; an empty table
    gives no rows.  A text of any length is cut and cleaned whole, by one task.
    """
    docs = docs.drop("removed_words", "removed")
    kind = docs.schema[id_col].dataType.simpleString()
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    found = docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), F.col(text_col).alias("text")).mapInArrow(
        partial(_units, min_words=min_unit_words), f"doc_id {kind}, row long, pos int, n_words int, digest long"
    )
    found = written(found)
    # rows equal in id and text are one: an occurrence counts once
    twice = written(found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    hits = written(found.join(twice, "digest", "left_semi"))
    place = F.struct("doc_id", "row", "pos")
    # written, so that the join below reads plain exchanges, whose hot keys can be split
    first = written(hits.groupBy("digest").agg(F.min(place).alias("first")))
    later = hits.join(first, "digest").where(~place.eqNullSafe(F.col("first")))
    marked = later.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set(F.struct("pos", "n_words")).alias("__repeated"))
    names = ["text" if c == text_col else c for c in docs.columns]
    keyed = docs.withColumn("__key", row).withColumnRenamed(text_col, "text")
    joined = keyed.join(marked, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__row")), "left").drop("__id", "__row", "__key")
    schema = ", ".join(f"`{f.name if f.name != text_col else 'text'}` {f.dataType.simpleString()}" for f in docs.schema)
    out = joined.mapInArrow(
        partial(_cleaned, min_words=min_unit_words, min_run=min_run_words, names=names), f"{schema}, removed_words long, removed array<struct<start:long,length:long,n_words:long>>"
    )
    return out.withColumnRenamed("text", text_col)
