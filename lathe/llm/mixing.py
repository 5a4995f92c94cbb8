"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional copy count, target
over source size. Rows of one id, source and size are one unit, counted before
anything is shuffled, so that a common id is no hot group; its rows share the
unit's copies evenly. The whole part is taken at once; the fraction is rounded by
pivotal steps: two fractional documents exchange words, one gaining what the
other loses, until one of them is a whole copy. Which way the words move is
drawn so that expectations hold. Buckets of documents are rounded in parallel;
each leaves at most one fractional document per source, and those residuals
are combined in a reduction tree until one per source is left and drawn alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
#: Units (equal rows together) rounded in one step; sources get as many buckets as they need.
BUCKET = 1024
#: Residuals that one node of the reduction tree combines.
FAN_IN = 256


def fair_targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Targets by weight that stop at ``cap`` times the size; the excess is reshared by weight."""
    target = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = cap * sizes[i]
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def pivotal(size: np.ndarray, fraction: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Round fractions of documents by word-preserving pivotal steps.

    Returns whole copies (0 or 1) per row, and the row and fraction still open
    (-1 if none).
    """
    up = np.zeros(len(size), dtype=np.int64)
    open_row, open_p = -1, 0.0
    for i, (s, p, u) in enumerate(zip(size.tolist(), fraction.tolist(), draw.tolist())):
        if p <= 1e-12 or p >= 1 - 1e-12:
            up[i] = p > 0.5
            continue
        if open_row < 0:
            open_row, open_p = i, p
            continue
        t = size[open_row]
        gain = min((1 - p) * s, open_p * t)
        loss = min(p * s, (1 - open_p) * t)
        if u * (gain + loss) < loss:
            p, q = p + gain / s, open_p - gain / t
        else:
            p, q = p - loss / s, open_p + loss / t
        whole_p, whole_q = p <= 1e-9 or p >= 1 - 1e-9, q <= 1e-9 or q >= 1 - 1e-9
        if whole_p:
            up[i] = p > 0.5
        if whole_q:
            up[open_row] = q > 0.5
            open_row, open_p = -1, 0.0
            if not whole_p:
                open_row, open_p = i, p
        else:
            open_p = q
            if not whole_p:  # pragma: no cover - one side always becomes whole
                up[i] = p > 0.5
    return up, open_row, open_p


_COLUMNS = ["row_key", "doc_id", "source", "size", "times", "fraction", "draw", "copies"]


def _round_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["size", "draw", "row_key"], kind="stable").reset_index(drop=True)
    up, row, p = pivotal(group["size"].to_numpy(), group["fraction"].to_numpy(), group["draw"].to_numpy())
    fraction = np.zeros(len(group))
    if row >= 0:
        fraction[row] = p
    return group.assign(copies=group["copies"].to_numpy() + up, fraction=fraction)[_COLUMNS]


def mix_units(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = 7,
) -> DataFrame:
    """Copies that bring every source near its target, per unit of rows of equal id, source and size.

    Returns doc_id, source, size, source_size, target, times (rows of the unit)
    and copies (of all of them together). Null texts have size 0; rows of size
    0 take one copy each (no words). The null source is a source, last in
    order. Extra columns are not read. An empty table gives no rows. One row
    per source (its total) goes to the driver.
    """
    spark = docs.sparkSession
    word = r"[^\x20\x09-\x0D]+"
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(word)), F.lit(0)).cast("long").alias("size"),
    )
    units = shared.materialize(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")))
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["source_size"] for r in totals]
    target = fair_targets(sizes, [weights[i % len(weights)] for i in range(len(totals))], share, cap)
    # One row per source, as the totals above.
    plan = spark.createDataFrame(
        [
            (r["source"], int(r["source_size"]), float(t), t / r["source_size"] if r["source_size"] else 0.0, max(1, -(-r["n"] // BUCKET)))
            for r, t in zip(totals, target)
        ],
        "source string, source_size long, target double, ratio double, buckets long",
    )
    by_source = lambda df: df.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).drop(F.col("p.source"))
    mean = F.when(F.col("size") > 0, F.col("ratio") * F.col("times")).otherwise(F.col("times").cast("double"))
    kind = units.schema["doc_id"].dataType
    start = by_source(units).select(
        F.col("doc_id").cast("string").alias("doc_id"),  # pandas would make a float of a number with nulls
        "source",
        "size",
        "times",
        F.floor(mean).cast("long").alias("copies"),
        (mean - F.floor(mean)).alias("fraction"),
        F.xxhash64("doc_id", "source", "size", F.lit(seed)).alias("row_key"),
        "buckets",
    ).withColumn("draw", F.pmod(F.xxhash64(F.col("row_key"), F.lit(seed + 1)), F.lit(1 << 52)) / float(1 << 52))
    # A unit's key sorts it, and no two units of a bucket have equal size, draw and key, unless two keys of 64 bits collide.
    bucketed = start.withColumn("node", F.pmod(F.xxhash64("row_key", F.lit(seed + 2)), F.col("buckets")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in start.select(*_COLUMNS).schema.fields)
    groups = max((max(1, -(-r["n"] // BUCKET)) for r in totals), default=1)
    level, closed = bucketed, None
    # Each bucket leaves one open unit at most; the tree closes them level by level.
    while True:
        level = shared.materialize(level.groupBy("source", "node").applyInPandas(lambda g: _round_group(g), schema))
        part = level.where(F.col("fraction") == 0)
        closed = part if closed is None else closed.unionByName(part)
        level = level.where(F.col("fraction") > 0)
        if groups == 1:
            break
        groups = -(-groups // FAN_IN)
        level = level.withColumn("node", F.pmod(F.xxhash64("row_key", F.lit(seed + 10 + groups)), F.lit(groups)))
    last = level.withColumn("copies", F.col("copies") + (F.col("draw") < F.col("fraction")).cast("long"))
    done = by_source(closed.unionByName(last))
    return done.select(F.col("doc_id").cast(kind).alias("doc_id"), "source", "size", "source_size", "target", "times", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Copies of each row that bring every source near its target; ``options`` are those of ``mix_units``.

    Returns one row per input row: doc_id, source, size, source_size, target,
    copies, taken. Equal rows are interchangeable: their copies differ by one
    at most. Nulls, empty texts and tables, extra columns: as in ``mix_units``.
    """
    units = mix_units(docs, id_col, text_col, source_col, **options)
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth")
    each = units.select("doc_id", "source", "size", "source_size", "target", "copies", "times", nth)
    copies = F.floor(F.col("copies") / F.col("times")).cast("long") + (F.col("nth") <= F.col("copies") % F.col("times")).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
