"""Near copies by SimHash and by the Jaccard similarity of their shingles.

Texts are collapsed to distinct normalised ones.  Those whose SimHash fingerprints
differ in few bits are linked first, through the vantage-point tree of ``simhash``,
as they are there.  Most texts of similarity 0.8 differ in about ten of 64 bits,
and at such a radius no triangle bound prunes; so what fingerprints miss is found
by min-hashes in bands and compared exactly.  With 24 bands of five hashes a pair
of similarity 0.8 shares none in 7 of 100,000 cases.

A band's key makes a block of texts.  First each text meets the hub of each of its
blocks, the member that shares most with all others: copies of one original all
meet it, so a group of any size is linked by about as many comparisons as it has
members.  What a block holds beside its largest linked part then meets all members
that it isn't linked with: as pairs in blocks of up to ``SMALL`` texts, in larger
ones as tiles of bounded size, which hold each text once instead of once for each
pair.  Every two texts that share a band are so linked or compared; nothing is capped.
"""

from __future__ import annotations

from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hold, raw, written
from .simhash import components, fingerprint
from .simhash import links as alike

BANDS, ROWS = 24, 5
#: Shingles min-hashed at a time.
BLOCK = 1024
#: Texts of a block up to which its members meet as pairs, and of each side of a tile on average.
SMALL, TILE = 32, 256
#: Links up to which one task joins them all; more are joined by rounds of exchanges.
FEW = 1 << 20
_draw = np.random.default_rng(17).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
ODD, FLIP = _draw[0] | np.uint32(1), _draw[1]


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def name_of(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a normalised text; a shorter text is one shingle."""
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    size = min(size, len(gaps) + 1)
    starts = np.concatenate(([0], gaps + 1))[: len(gaps) + 2 - size].tolist()
    ends = np.concatenate((gaps, [len(text)]))[size - 1 :].tolist()
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, (text[s:e] for s, e in zip(starts, ends)), repeat(42))), ">u8").astype(np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes."""
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    high = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), BLOCK):
        np.minimum(low, ((high[at : at + BLOCK] ^ FLIP) * ODD).min(axis=1), out=low)
    rows = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _prints(batches, id_col: str, text_col: str, size: int):
    hold("nearcopies")
    for b in batches:
        texts = [normal(t) for t in raw(b, text_col)]
        keys = [bands(shingles(t, size)) for t in texts]
        fp = np.frombuffer(b"".join(map(fingerprint, texts)), ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(id_col)), pa.array([name_of(t) for t in texts], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fp)], ["doc_id", "u", "keys", "fp"])


def _named(batches, text_col: str):
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([name_of(normal(t)) for t in raw(b, text_col)], pa.int64())], [*b.schema.names, "__u"])


def _sets(batches, text_col: str, size: int):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("__u")), pa.array([shingles(normal(t), size).tobytes() for t in raw(b, text_col)], pa.binary())], ["u", "found"])


def _similar(batches, least: float):
    for b in batches:
        u, v, one, two = (c.to_pylist() for c in b.columns)
        near = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(one, two)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(u, near) if k], pa.int64()), pa.array([x for x, k in zip(v, near) if k], pa.int64())], ["u", "v"])


def links(sets: list[np.ndarray], some: list[int], every: list[int], part: list[int], least: float) -> list[tuple[int, int]]:
    """Links of at least ``least`` between members of ``some`` and ``every`` of different parts; what they join is one part from then on."""
    if not some or not every:
        return []
    codes, of = np.unique(np.concatenate([sets[k] for k in every]), return_inverse=True)
    size = np.array([len(sets[k]) for k in every])
    starts, here = np.cumsum(size) - size, np.zeros(len(codes), bool)
    mine, theirs, out = np.array([part[k] for k in some]), np.array([part[k] for k in every]), []
    for i, k in enumerate(some):
        at = np.searchsorted(codes, sets[k])
        at = at[codes[np.minimum(at, len(codes) - 1)] == sets[k]]
        here[at] = True
        both = np.add.reduceat(here[of].astype(np.int64), starts)
        here[at] = False
        for j in np.flatnonzero(both >= least * (len(sets[k]) + size - both)).tolist():
            if theirs[j] != mine[i]:
                out.append((k, every[j]))
                mine[mine == theirs[j]] = mine[i]
                theirs[theirs == theirs[j]] = mine[i]
    return out


def _tiles(batches, least: float):
    """Streams sorted rows (key, i, j, some, u, root, found); a tile's rows follow each other."""
    held: list[tuple] = []
    tile = None

    def done():
        sets, part = [np.frombuffer(r[3], np.uint64) for r in held], [r[2] for r in held]
        found = links(sets, [k for k, r in enumerate(held) if r[0]], [k for k, r in enumerate(held) if not r[0]], part, least)
        return pa.RecordBatch.from_arrays([pa.array([held[a][1] for a, _ in found], pa.int64()), pa.array([held[b][1] for _, b in found], pa.int64())], ["u", "v"])

    for b in batches:
        for key, i, j, *row in zip(*[c.to_pylist() for c in b.columns]):
            if (key, i, j) != tile:
                if held:
                    yield done()
                tile, held = (key, i, j), []
            held.append(tuple(row))
    if held:
        yield done()


def _rows_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row, with ``__u``, for each (first, u) of ``wanted``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", __u long"
    named = docs.mapInArrow(partial(_named, text_col=text_col), schema)
    some = wanted.select(F.col("first").alias("__first"), F.col("u").alias("__name"))
    # a join on id and text, so that copies of a text don't meet in one task
    known = named.join(some, (F.col(id_col) == F.col("__first")) & (F.col("__u") == F.col("__name")), "left_semi").dropDuplicates([id_col, "__u"])
    lost = named.where(F.col(id_col).isNull()).join(some.where("__first IS NULL"), F.col("__u") == F.col("__name"), "left_semi").dropDuplicates(["__u"])
    return known.unionByName(lost)


def _printed(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) that join all texts whose fingerprints are within ``radius``, one text standing for each fingerprint."""
    points = written(nodes.groupBy("fp").agg(F.min("u").alias("lead")))
    equal = nodes.select("fp", "u").join(points, "fp").where("u != lead").select("u", F.col("lead").alias("v"))
    one, two = (points.select(F.col("fp").alias(n), F.col("lead").alias(f"{n}_text")) for n in "uv")
    near = alike(points, radius).join(one, "u").join(two, "v").select(F.col("u_text").alias("u"), F.col("v_text").alias("v"))
    return written(equal.union(near))


def representatives(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(u, first) of the text of each group that holds its smallest id: the text's hash and that id, null if no text has one."""
    kind = docs.schema[id_col].dataType.simpleString()
    prints = docs.select(id_col, text_col).mapInArrow(partial(_prints, id_col=id_col, text_col=text_col, size=shingle), f"doc_id {kind}, u long, keys array<long>, fp long")
    # a text's copies have equal keys and fingerprints, so any will do
    nodes = written(prints.groupBy("u").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.first("fp").alias("fp")))
    label = nodes.select("u", F.struct(F.col("first").isNull().alias("lost"), "first", "u").alias("label"))
    once = nodes.select("u", F.explode("keys").alias("key"))
    # small tables are written, so that joins read plain exchanges, whose hot keys can be split
    blocks = written(once.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = written(once.join(blocks, "key"))
    hubs = members.groupBy("u").agg(F.sum("n").alias("hub"))
    ranked = written(members.join(hubs, "u"))
    lead = written(ranked.groupBy("key").agg(F.max_by("u", F.struct("hub", "u")).alias("lead")))
    led = written(ranked.join(lead, "key").where("u != lead").select("u", F.col("lead").alias("v")).distinct())
    # only texts that share a band are looked at again
    need = members.select("u").distinct().join(nodes.select("u", "first"), "u")
    sets = written(_rows_of(docs.select(id_col, text_col), need, id_col, text_col).mapInArrow(partial(_sets, text_col=text_col, size=shingle), "u long, found binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        other = sets.select(F.col("u").alias("v"), F.col("found").alias("other"))
        near = pairs.join(sets, "u").join(other, "v").where(F.least(F.length("found"), F.length("other")) >= F.lit(least - 1e-9) * F.greatest(F.length("found"), F.length("other")))
        return written(near.select("u", "v", "found", "other").mapInArrow(partial(_similar, least=least), "u long, v long"))

    edges = verified(led)
    if radius is not None:
        edges = edges.union(_printed(nodes, radius))
    roots = checkpointed(components(edges, few=FEW))
    placed = members.join(roots, F.col("u") == F.col("node"), "left").select("key", "u", "n", F.coalesce("root", "u").alias("root"))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("size"), F.max("n").alias("n"))
    # in each block that is not one part: its largest part, and what is beside it
    open_ = parts.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("size"), F.max("n").alias("n")).where("size < n")
    open_ = written(open_)
    split = written(placed.drop("n").join(open_.select("key", "main", "n", (F.col("n") - F.col("size")).alias("rest")), "key"))
    small, large = split.where(F.col("n") <= SMALL), split.where(F.col("n") > SMALL)
    other = small.select("key", F.col("u").alias("v"), F.col("root").alias("other"))
    pairs = small.where("root != main").join(other, "key").where("root != other").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    far = verified(written(pairs.join(led, ["u", "v"], "left_anti")))
    # sides of a tile are dealt by hash, so that each has about TILE texts
    tiles, sides = F.ceil(F.col("n") / TILE).cast("int"), F.ceil(F.col("rest") / TILE).cast("int")
    hashed = lambda n: F.pmod(F.xxhash64("u"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    some = large.where("root != main").select("key", hashed(sides).alias("i"), all_of(tiles).alias("j"), F.lit(True).alias("some"), "u", "root")
    whole = large.select("key", all_of(sides).alias("i"), hashed(tiles).alias("j"), F.lit(False).alias("some"), "u", "root")
    laid = some.union(whole).join(sets, "u").select("key", "i", "j", "some", "u", "root", "found")
    dealt = laid.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    wide = written(dealt.mapInArrow(partial(_tiles, least=least), "u long, v long"))
    # the smallest label of a group is that of the document to keep
    every = edges.union(far).union(wide).join(label, "u").select(F.col("label").alias("a"), F.col("v").alias("u")).join(label, "u").select(F.col("a").alias("u"), F.col("label").alias("v"))
    gone = components(every, few=FEW).where("node != root").select("node.u")
    return nodes.join(gone, "u", "left_anti").select("u", "first")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group that links of Jaccard similarity ``least`` or more join: that of the smallest id.

    With ``radius``, SimHash fingerprints (four-word shingles) of at most so many
    differing bits are links, too.  All columns stay.  Texts that differ in case of A-Z or white space alone are
    copies.  Rows that share an id but not a text are documents of their own; of a
    group whose ids are all null, one row stays; of rows equal in id and text one,
    whichever.  Null and empty texts are alike.  A text shorter than a shingle is
    one; long texts are compared whole.  An empty table gives no rows; of the
    columns' names only ``__u``, ``__first`` and ``__name`` are reserved.
    """
    return _rows_of(docs, written(representatives(docs, shingle, least, radius, id_col, text_col)), id_col, text_col).select(*docs.columns)
