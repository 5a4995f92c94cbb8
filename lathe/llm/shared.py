"""Helpers shared by the operators: scratch tables, clash-free columns, text blocks.

A text block turns a list of texts into one byte buffer with the places and
64-bit hashes of its words, so the per-word work of every operator is done by
numpy over whole buffers.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the cluster's shared folder, or in the session's warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lathe-{uuid.uuid4().hex}"


def release() -> None:
    """Give the memory that a worker no longer uses back to the system: idle workers live on beside the next stages."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A batch function for mapInPandas that releases its memory when its partition ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def slices(batches, size: int, *texts: str) -> Iterator:
    """The batches in slices of about ``size`` characters of the text columns, or one longer row: memory does not grow with the length of texts."""
    for batch in batches:
        if not len(batch):
            continue
        total = np.full(len(batch), 64, dtype=np.int64)
        for t in texts:
            total += np.fromiter((len(x) if x is not None else 0 for x in batch[t]), np.int64, len(batch))
        piece = np.cumsum(total) // size
        edges = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        for lo, hi in zip(edges, [*edges[1:], len(batch)]):
            yield batch.iloc[lo:hi]


#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    The shuffle files of the query that wrote the table go with its end.
    """
    spark = df.sparkSession
    path = scratch_dir(spark) if folder is None else f"{folder}/{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of tables that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def pieces(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(buffer, piece starts, document of each piece); buffers of about ``limit`` bytes.

    A text longer than the limit is cut at separators, so words stay whole and
    memory is bounded by the longest word.
    """
    parts: list[bytes] = []
    docs: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        data = encode(text)
        at = 0
        while at < len(data):
            stop = len(data)
            if stop - at > limit:
                stop = at + limit
                while stop < len(data) and data[stop] not in SEPARATORS:
                    stop += 1
            parts.append(data[at:stop])
            docs.append(i)
            held += stop - at
            at = stop
            if held >= limit:
                yield _joined(parts, docs)
                parts, docs, held = [], [], 0
    if parts:
        yield _joined(parts, docs)


def _joined(parts: list[bytes], docs: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return b"\n".join(parts) + b"\n", starts, np.asarray(docs, dtype=np.int64)


def words(buffer: bytes, starts: np.ndarray, docs: np.ndarray, lower: bool = False):
    """(buffer as bytes, word starts, word ends, document, 64-bit hash) of one block."""
    raw = np.frombuffer(buffer, dtype=np.uint8)
    if lower:
        raw = _LOWER[raw]
    sep = _IS_SEP[raw]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if not sep[0]:
        edge = np.concatenate(([0], edge))
    first, last = edge[0::2], edge[1::2]
    n = len(raw)
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE[raw] * _power_table("up", _BASE, n), out=prefix[1:])
    back = _power_table("down", pow(_BASE, -1, 1 << 64), n)
    h = (prefix[last] - prefix[first]) * back[first]
    h = mix64(h ^ ((last - first).astype(np.uint64) << np.uint64(40)))
    doc = docs[np.searchsorted(starts, first, side="right") - 1] if len(first) else np.zeros(0, np.int64)
    return raw, first, last, doc, h


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word of a batch, in text order."""
    hs, ds = [], []
    for block in pieces(texts):
        _, _, _, doc, h = words(*block, lower=lower)
        hs.append(h)
        ds.append(doc)
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hs), np.concatenate(ds)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def matrix(vectors) -> np.ndarray:
    """Rows of equal length as one matrix of doubles."""
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def finite_vector(col: str) -> Column:
    """Whether an array column is a vector: not null, not empty, no null or non-finite component."""
    bad = F.exists(
        F.col(col),
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    return F.coalesce((F.size(F.col(col)) > 0) & ~bad, F.lit(False))
