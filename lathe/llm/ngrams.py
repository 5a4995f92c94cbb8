"""Hashed byte n-gram counts of whole texts, and their TF-IDF weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Rows whose dense counts are held at once.
ROWS = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def counts(texts: list[str | None], dims: int, orders: tuple[int, ...], lower: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, counts[row, dim]) of blocks of texts; n-grams never join two texts."""
    bits = np.uint32(32 - int(np.log2(dims)))
    for lo in range(0, len(texts), ROWS):
        part = texts[lo : lo + ROWS]
        out = np.zeros((len(part), dims), dtype=np.float32)
        for buffer, starts, docs in shared.pieces(part, 2 << 20):
            raw = np.frombuffer(buffer, dtype=np.uint8)
            if lower:
                raw = _LOWER[raw]
            lengths = np.diff(np.append(starts, len(raw)))
            row = np.repeat(docs * dims, lengths)
            code = np.zeros(len(raw), dtype=np.uint32)
            for n in range(1, max(orders) + 1):
                if len(raw) < n:
                    break
                tail = raw[n - 1 :].astype(np.uint32)
                code = code[: len(tail)] * np.uint32(257) + tail + np.uint32(1)
                if n not in orders:
                    continue
                slot = ((code * np.uint32(2654435761)) ^ np.uint32(n * 40503)) >> bits
                at = row[: len(slot)] + slot
                inside = row[: len(slot)] == row[n - 1 :]
                out += np.bincount(at[inside], minlength=out.size).astype(np.float32).reshape(out.shape)
        yield lo, lo + len(part), out


def document_frequency(docs: DataFrame, text_col: str, dims: int, terms) -> tuple[np.ndarray, int]:
    """Texts that hold each dimension of ``terms`` (a function like ``counts``), and texts, over all rows; one short vector a task is summed."""

    @shared.tidy
    def run(batches):
        total = np.zeros(dims, dtype=np.int64)
        n = 0
        for batch in batches:
            for _, _, c in terms(batch[text_col].tolist()):
                total += (c > 0).sum(axis=0)
                n += len(c)
        yield pd.DataFrame({"dim": np.arange(-1, dims), "n": np.concatenate(([n], total))})

    rows = docs.select(text_col).mapInPandas(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(dims)
    inside = rows["dim"] >= 0
    df[rows["dim"][inside].to_numpy()] = rows["n"][inside].to_numpy()
    return df, int(rows["n"][~inside].sum())


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1.0 + n) / (1.0 + df)) + 1.0).astype(np.float32)


def weigh(c: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows with dampened counts; a row without n-grams stays zero."""
    x = np.sqrt(c) * weights
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def sample_rate(total: int, wanted: int) -> float:
    return 1.0 if total <= wanted else wanted / total


def sampled(cols: list[str], rate, seed: int):
    """A condition that holds for about ``rate`` of the distinct values of the columns, the same ones on every run."""
    rate = rate if not isinstance(rate, float) else F.lit(rate)
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40)) < rate * float(1 << 40)
