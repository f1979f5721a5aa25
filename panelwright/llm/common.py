"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` finds the same runs.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only where it is unset, as in tests on one machine, a temporary one is made;
    on a cluster that would be a folder no other machine sees, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="shared_")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


@contextmanager
def uncollected():
    """Without passes of the collector of cycles, which code that makes many small objects and no cycles pays for in vain."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def given_back() -> None:
    """Let the system have the memory that a worker has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # of one C library only
        ctypes.CDLL(None).malloc_trim(0)


_HOLDER: dict[str, tuple] = {}


def hold(owner: str, *caches) -> None:
    """Say which operator's caches a worker keeps: those of the one before are emptied, as workers live on."""
    if owner not in _HOLDER:
        for held in _HOLDER.values():
            for cache in held:
                cache.clear()
        if _HOLDER:
            given_back()
        _HOLDER.clear()
    _HOLDER[owner] = caches


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8; nulls become empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def dealt_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts as a binary array, the index of each occurrence, texts laid end to end, and their numbers of words."""
    if not texts:
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
    coded = lists.flatten().dictionary_encode()
    words, index, size = coded.dictionary.view(pa.binary()), coded.indices.to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy())
    # white space at an end or in a row gives empty words; every text, an empty one, too, has at least one word so far
    if (none := pc.index(words, pa.scalar(b"", pa.binary())).as_py()) >= 0:
        real = index != none
        size = np.add.reduceat(real.astype(np.int64), np.cumsum(size) - size)
        words = pa.concat_arrays([words.slice(0, none), words.slice(none + 1)])
        index = index[real]
        index -= index > none
    return words, index, size.astype(np.int64)


def ends_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary array's bytes and where each value begins, and the last one ends."""
    offsets = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_binary(words.type) else np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets
