"""Packing along a space-filling curve.

Each document is tokenized once.  Its ids are hashed into a signed vector,
damped, normalised and projected to three dimensions; the Hilbert index of that
point, with a hash of the row below it, is the sort key.  The number of ranges
follows the size of the texts; their bounds come from a sample of keys, some for
each range; every row carries its range number, and each range is
sorted and cut into sequences as one stream: no padding inside, and the last
sequence of a range is cut at powers of two, which need none.  Copies share a
curve position but not a key, and neither do rows that repeat or have no id, so a
group of any size spreads over ranges.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw
from .tokens import load, vocabulary

DIMS, BITS, HASHED = 3, 10, 256


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of rows of unsigned integers below 2**bits.

    Works on the transposed index: undo excess work from the top bit down,
    Gray-encode, then interleave.
    """
    x = points.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        p = q - one
        for i in range(len(x)):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p).astype(np.uint64)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t = np.where((x[-1] & q) != 0, t ^ (q - one), t)
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def curve_keys(ids: list[np.ndarray], seed: int = 5) -> np.ndarray:
    """The curve position of each document's hashed vector."""
    rng = np.random.default_rng(seed)
    project = rng.standard_normal((HASHED, DIMS))
    bucket = rng.integers(0, HASHED, 1 << 16)
    sign = rng.choice((-1.0, 1.0), 1 << 16)
    h = np.zeros((len(ids), HASHED))
    for k, x in enumerate(ids):
        h[k] = np.bincount(bucket[x], sign[x], HASHED)
    h = np.sign(h) * np.log1p(np.abs(h))
    h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
    unit = 1 / (1 + np.exp(-1.702 * (h @ project)))  # close to the normal distribution function
    return hilbert(np.clip((unit * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def _keyed(batches, path: str, end_id: int, bounds: np.ndarray | None, keys_only: bool):
    tokenizer = load(path)
    tail = np.array([end_id], "<u2").tobytes()
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            ids = [x + tail for x in tokenizer.ids(raw(part, "text"))]
            key = (curve_keys([np.frombuffer(x, "<u2") for x in ids]) << 32) | part.column(part.schema.get_field_index("salt")).to_numpy(zero_copy_only=False)
            if keys_only:
                yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])
                continue
            to = np.searchsorted(bounds, key, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(key), part.column(part.schema.get_field_index("doc_id")), pa.array(ids, pa.binary())], ["part", "key", "doc_id", "ids"])


def cut(lengths: list[int], size: int):
    """Cut a stream of documents into full sequences and a tail at powers of two.

    Yields (document, start, length, sequence, offset).
    """
    total = sum(lengths)
    whole, rest = divmod(total, size)
    sizes = [size] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    seq = offset = 0
    for k, n in enumerate(lengths):
        start = 0
        while start < n:
            take = min(n - start, sizes[seq] - offset)
            yield k, start, take, seq, offset
            start += take
            offset += take
            if offset == sizes[seq]:
                seq, offset = seq + 1, 0


def _packed(batches, size: int):
    """Streams a range: only the documents of the sequence being filled are held."""
    base, seq, held, fill = TaskContext.get().partitionId() << 40, 0, [], 0

    def emit(docs: list[tuple], first: int):
        rows = [(docs[k], start, n, s, o) for k, start, n, s, o in cut([d[3] - d[2] for d in docs], size)]
        ids = [d[1][2 * (d[2] + start) : 2 * (d[2] + start + n)] for d, start, n, _, _ in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d[0] for d, *_ in rows], kind),
                pa.array([d[2] + start for d, start, *_ in rows], pa.int64()),
                pa.array([n for _, _, n, _, _ in rows], pa.int64()),
                pa.array([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array([len(d[1]) // 2 for d, *_ in rows], pa.int64()),
                pa.array([base + first + s for *_, s, _ in rows], pa.int64()),
                pa.array([o for *_, o in rows], pa.int64()),
                pa.array(ids, pa.binary()),
            ],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    for b in batches:
        kind = b.schema.field("doc_id").type
        for doc_id, ids in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), b.column(b.schema.get_field_index("ids")).to_pylist()):
            held.append((doc_id, ids, 0, len(ids) // 2))
            fill += len(ids) // 2
        if whole := fill // size:
            room, ready, rest = whole * size, [], []
            for d in held:
                take = min(room, d[3] - d[2])
                room -= take
                if take:
                    ready.append((d[0], d[1], d[2], d[2] + take))
                if d[2] + take < d[3]:
                    rest.append((d[0], d[1], d[2] + take, d[3]))
            yield emit(ready, seq)
            seq, held, fill = seq + whole, rest, fill - whole * size
    if held:
        yield emit(held, seq)


def pack(
    docs: DataFrame, size: int = 4096, tokenizer: str | None = None, end_id: int = 2, range_bytes: int = 1 << 26, range_sample: int = 64, least_sample: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents along the curve, with their ids.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids
    (unsigned 16-bit, little-endian).  Null and empty texts are their end id
    alone; repeated rows are packed as often as they occur; documents of equal
    keys are ordered by id; long texts are tokenized whole and cut over as many
    sequences as they fill; an empty table gives no rows; other columns are not
    read, so their names may clash.  There is a range for each ``range_bytes`` of
    text, and no less than shuffle partitions; ``range_sample`` documents for
    each, ``least_sample`` in all, are tokenized to place their bounds.
    """
    spark = docs.sparkSession
    path = tokenizer or vocabulary()
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text_col)).cast("long")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    sample = max(least_sample, range_sample * parts)
    # rows are told apart by their place in the input, which a task that runs again finds as before
    salt = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(1 << 32))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), salt.alias("salt"))
    # another hash than the salt's, which is part of the key
    drawn = F.pmod(F.xxhash64("salt", F.lit("sample")), F.lit(1 << 32))
    # some of many rows, by their hash; each key is computed as in the main pass
    some = rows.where(drawn < F.lit(int(min(1.0, 1.5 * sample / max(1, n)) * (1 << 32)))).limit(2 * sample).repartition(8, "salt")
    keys = np.sort(some.mapInArrow(partial(_keyed, path=path, end_id=end_id, bounds=None, keys_only=True), "key long").toPandas()["key"].to_numpy(np.int64))
    bounds = np.unique(keys[[len(keys) * k // parts for k in range(1, parts)]]) if len(keys) else keys
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = rows.mapInArrow(partial(_keyed, path=path, end_id=end_id, bounds=bounds, keys_only=False), f"part int, key long, doc_id {kind}, ids binary")
    ranged = keyed.repartitionById(parts, F.col("part")).drop("part").sortWithinPartitions("key", "doc_id", "ids")
    return ranged.mapInArrow(
        partial(_packed, size=size), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
