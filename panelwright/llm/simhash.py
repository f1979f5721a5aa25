"""SimHash near-duplicates through vantage-point trees.

Fingerprints are computed once per document and collapsed to distinct values,
so a group of exact copies of any size is one point.  A top tree, fitted on a
bounded sample of distinct fingerprints, cuts Hamming space into shards.  Each
point has one home shard.  Where a point of the inner side lies within the
radius of a node's boundary, a ghost of it also goes to the outer side, and
ghosts follow every branch that the triangle inequality cannot exclude.  So for
each linked pair, some shard holds one point as native and the other as native
or ghost, whatever the sample was: the result is exact.  Inside a shard the
same recursion runs on until blocks are small enough to compare.  Shards emit a
spanning forest, never all pairs; components come from distributed star
contraction.  Distinct points within one radius are bounded by geometry, and
exact copies are collapsed first, so no group is held by one task.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, raw

#: Shingles hashed and counted at a time, so that long texts need bounded memory.
BLOCK = 1 << 16
#: Types that Arrow sorts as Spark does.
ORDERED = {"boolean", "tinyint", "smallint", "int", "bigint", "string", "date"}
#: Pairs compared at a time in a shard.
TILE = 1 << 21


def fingerprint(text: bytes, size: int = 4) -> bytes:
    """The big-endian 64-bit fingerprint of a text."""
    found = text.lower().split()  # bytes.lower() touches A-Z only
    if not found:
        return bytes(8)
    joined = b" ".join(found)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    size = min(size, len(found))
    starts = np.concatenate(([0], gaps + 1))[: len(found) - size + 1].tolist()
    ends = np.concatenate((gaps, [len(joined)]))[size - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        parts = [joined[s:e] for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        digests = b"".join(map(xxhash.xxh64_digest, parts, repeat(42)))
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(starts)).tobytes()


def _fingerprints(batches, id_col: str, text_col: str, size: int):
    for b in batches:
        fp = np.frombuffer(b"".join(fingerprint(t, size) for t in raw(b, text_col)), ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(id_col)), pa.array(fp)], ["doc_id", "fp"])


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def split_point(points: np.ndarray, rng: np.random.Generator, tries: int = 8) -> tuple[np.uint64, int]:
    """Of a few candidates, the vantage point whose distances spread most; and the median distance."""
    best = max((points[i] for i in rng.integers(0, len(points), tries)), key=lambda v: float(distance(points, v).std()))
    d = np.sort(distance(points, best))
    return best, int(d[(len(d) - 1) // 2])


NODE = np.dtype([("vantage", np.uint64), ("threshold", np.int16), ("inner", np.int32), ("outer", np.int32)])


def build_tree(sample: np.ndarray, levels: int, seed: int = 7) -> np.ndarray:
    """Nodes, the root first; one of threshold -1 is a leaf and ``inner`` is its shard."""
    rng, nodes, shards = np.random.default_rng(seed), [], 0
    todo = [(sample, levels, -1, 0)]
    while todo:
        points, left, above, side = todo.pop()
        at = len(nodes)
        if above >= 0:
            nodes[above][side] = at
        v, t, inner = 0, -1, np.zeros(0, bool)
        if left and len(points) > 1:
            v, t = split_point(points, rng)
            inner = distance(points, v) <= t
        if inner.any() and not inner.all():
            nodes.append([int(v), t, 0, 0])
            todo += [(points[~inner], left - 1, at, 3), (points[inner], left - 1, at, 2)]
        else:
            nodes.append([0, -1, shards, 0])
            shards += 1
    return np.array([tuple(x) for x in nodes], NODE)


def route(nodes: np.ndarray, points: np.ndarray, radius: int):
    """Yield (shard, natives, ghosts) as index arrays into ``points``."""
    none = np.zeros(0, np.int64)
    todo = [(0, np.arange(len(points)), none)]
    while todo:
        at, own, ghosts = todo.pop()
        if not len(own) and not len(ghosts):
            continue
        v, t, inner, outer = nodes[at].tolist()
        if t < 0:
            yield inner, own, ghosts
            continue
        d, g = distance(points[own], np.uint64(v)), distance(points[ghosts], np.uint64(v))
        todo.append((inner, own[d <= t], ghosts[g <= t + radius]))
        edge = own[(d <= t) & (d > t - radius)]
        todo.append((outer, own[d > t], np.concatenate((ghosts[g > t - radius], edge))))


def _route(batches, nodes, radius: int):
    for b in batches:
        points = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for shard, own, ghosts in route(nodes, points, radius):
            ids = np.concatenate((own, ghosts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), shard, np.int32)), pa.array(points[ids].view(np.int64)), pa.array(np.arange(len(ids)) < len(own))],
                ["shard", "fp", "native"],
            )


def unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Join the classes of u and v; every label is its class's smallest index."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            again = label[label]
            if (again == label).all():
                break
            label = again
    return label


def forest(points: np.ndarray, n_own: int, radius: int, seed: int = 11) -> np.ndarray:
    """Class labels of a shard's points (the first ``n_own`` are natives)."""
    rng, label = np.random.default_rng(seed), np.arange(len(points))
    todo = [(np.arange(n_own), np.arange(n_own, len(points)))]
    while todo:
        own, ghosts = todo.pop()
        if not len(own):
            continue
        if len(own) > 64 and len(own) * (len(own) + len(ghosts)) > TILE:
            v, t = split_point(points[own], rng)
            d = distance(points[own], v)
            if (d > t).any():
                g = distance(points[ghosts], v)
                todo.append((own[d <= t], ghosts[g <= t + radius]))
                todo.append((own[d > t], np.concatenate((ghosts[g > t - radius], own[(d <= t) & (d > t - radius)]))))
                continue
        every = np.concatenate((own, ghosts))
        step = max(1, TILE // 4 // len(every))
        for at in range(0, len(own), step):
            i, j = np.nonzero(np.bitwise_count(points[own[at : at + step], None] ^ points[None, every]) <= radius)
            real = own[at + i] != every[j]
            label = unite(label, own[at + i[real]], every[j[real]])
    return label


def _forest(radius: int):
    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["native", "fp"], ascending=[False, True])
        points = pdf["fp"].to_numpy().view(np.uint64)
        label = forest(points, int(pdf["native"].sum()), radius)
        moved = label != np.arange(len(label))
        signed = points.view(np.int64)
        return pd.DataFrame({"u": signed[moved], "v": signed[label[moved]]})

    return linked


def ranks(nodes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each value among the distinct ones, and a place where each of these stands; in structs, nulls come first."""
    parts = nodes.flatten() if pa.types.is_struct(nodes.type) else [nodes]
    names = [str(k) for k in range(len(parts))]
    order = pc.sort_indices(pa.table(parts, names), [(n, "ascending") for n in names], null_placement="at_start")
    new = np.zeros(max(len(nodes) - 1, 0), bool)
    for part in parts:
        a, b = part.take(order[:-1]), part.take(order[1:])
        alike = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new |= ~alike.to_numpy(zero_copy_only=False)
    order, new = order.to_numpy(), np.concatenate((np.ones(min(len(nodes), 1), bool), new))
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def _united(batches):
    """(node, root) of a whole edge list."""
    held = [(b.column(0), b.column(1)) for b in batches]
    if not held:
        return
    ends = pa.concat_arrays([a for a, _ in held] + [b for _, b in held])
    rank, at = ranks(ends)
    label = unite(np.arange(len(at)), rank[: len(rank) // 2], rank[len(rank) // 2 :])
    for k in range(0, len(at), 1 << 14):
        yield pa.RecordBatch.from_arrays([ends.take(pa.array(at[k : k + (1 << 14)])), ends.take(pa.array(at[label[k : k + (1 << 14)]]))], ["node", "root"])


def components(edges: DataFrame, max_rounds: int = 64, few: int = 0) -> DataFrame:
    """(node, root) for each node of an undirected edge list (u, v), by alternating star contraction.

    Nodes are of any type with an order; a root is the smallest node of its
    component.  Rounds grow with the logarithm of the nodes; RuntimeError if
    ``max_rounds`` were too few.  Up to ``few`` distinct links are joined by one
    task instead, with the same result and without the rounds' stages, if nodes are
    of the ``ORDERED`` types or structs of these.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()

    edges = checkpointed(edges.where("u != v").distinct())
    n = edges.count()
    kind = edges.schema["u"].dataType
    if 0 < n <= few and {f.dataType.simpleString() for f in getattr(kind, "fields", [edges.schema["u"]])} <= ORDERED:
        return edges.coalesce(1).mapInArrow(_united, f"node {kind.simpleString()}, root {kind.simpleString()}")
    for _ in range(max_rounds if n else 0):
        last, before, edges = edges, n, checkpointed(small(large(edges)))
        n = edges.count()
        if n == before and edges.join(last, ["u", "v"], "left_anti").isEmpty():
            break
    else:
        if n:
            raise RuntimeError(f"components are not found in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def links(nodes: DataFrame, radius: int = 4, min_levels: int = 6, shard_points: int = 16_384, leaf_sample: int = 64, most_sample: int = 1 << 20) -> DataFrame:
    """Pairs (u, v) of a table's distinct fingerprints ``fp`` that join all within ``radius``: a forest of each shard of the vantage-point tree."""
    n = nodes.count()
    levels = max(min_levels, math.ceil(math.log2(max(1, n / shard_points))))
    sample = min(leaf_sample << levels, most_sample)
    # some of many prints, by their hash; at least a leaf's worth of any number
    drawn = F.pmod(F.xxhash64("fp"), F.lit(1 << 32)) < F.lit(int(min(1.0, sample / max(1, n)) * (1 << 32)))
    seen = np.sort(nodes.where(drawn).select("fp").limit(2 * sample).toPandas()["fp"].to_numpy(np.int64)).view(np.uint64)
    tree = build_tree(seen, levels)
    shards = nodes.select("fp").mapInArrow(partial(_route, nodes=tree, radius=radius), "shard int, fp long, native boolean")
    return checkpointed(shards.groupBy("shard").applyInPandas(_forest(radius), "u long, v long"))


def near_duplicates(
    docs: DataFrame, radius: int = 4, shingle: int = 4, min_levels: int = 6, shard_points: int = 16_384, leaf_sample: int = 64, most_sample: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that links of at most ``radius`` differing
    bits reach.  Null and empty texts share fingerprint zero and are linked like
    any other; null ids are members but never name a component, unless all are
    null; repeated rows give repeated results; long texts are hashed whole, in
    blocks; an empty table gives no rows; other columns are not read, so their
    names may clash.  The driver places shards by ``leaf_sample`` prints for each,
    ``most_sample`` (8 MB) in all; that changes balance, never results.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    prints = checkpointed(docs.select(id_col, text_col).mapInArrow(partial(_fingerprints, id_col=id_col, text_col=text_col, size=shingle), f"doc_id {kind}, fp long"))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = links(nodes, radius, min_levels, shard_points, leaf_sample, most_sample)
    # nodes are ordered by their smallest id, so a component's root names it and nothing is gathered by component
    label = nodes.select("fp", F.struct(F.col("first").isNull().alias("lost"), "first", "fp").alias("label"))
    ends = edges.join(label, F.col("u") == F.col("fp")).select(F.col("label").alias("a"), "v").join(label, F.col("v") == F.col("fp")).select(F.col("a").alias("u"), F.col("label").alias("v"))
    roots = components(ends).select(F.col("node.fp").alias("fp"), F.col("root.first").alias("component_id"), F.lit(True).alias("linked"))
    named = nodes.join(roots, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component: the one that names it, once for each text that its id has.

    Rows that share an id but not a text are documents of their own, of which
    only the id's own component decides; documents without an id can't name a
    component and are kept as they are.
    """
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__keep_id")).distinct()
    # the join deals rows by id, which the removal of repeated ids needs too
    named = docs.join(keep, F.col(id_col) == F.col("__keep_id"), "left_semi").dropDuplicates([id_col, text_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))
