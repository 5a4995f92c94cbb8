"""Exact top-k search: tiled matrix products, partial selection, tree merging.

Queries and candidates meet in tiles of bounded size. Each tile multiplies its
block of queries with its shard of candidates and keeps the k best per query;
the lists are merged first inside salted groups and then per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Queries per block and candidates per shard (on average, dealt by hash).
QUERY_BLOCK = 1024
SHARD = 4096
#: Groups in which the lists of one query are merged before the last merge.
MERGE_SALTS = 32
SCALE = 1024.0


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of one row, ties to the smaller id."""
    if len(scores) > k:
        bound = scores[np.argpartition(-scores, k - 1)[:k]].min()
        at = np.flatnonzero(scores >= bound)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles where they are exact, else 64-bit integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if top < 2.0**53:
        return (q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def _tile(k: int):
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        queries, shard = tile[tile["q"]], tile[~tile["q"]]
        out = {"query": [], "query_id": [], "row": [], "vec_id": [], "score": []}
        shards = {d: g for d, g in shard.groupby(shard["v"].map(len))}
        for dim, qs in queries.groupby(queries["v"].map(len)):
            cs = shards.get(dim)
            if cs is None:
                continue
            ids, own = cs["vec_id"].to_numpy(), cs["row"].to_numpy()
            scores = products(shared.matrix(qs["v"]), shared.matrix(cs["v"]))
            for line, query, query_id in zip(scores, qs["row"].to_numpy(), qs["vec_id"].to_numpy()):
                at = best(line, ids, k + 1)
                at = at[own[at] != query][:k]
                out["query"].append(np.full(len(at), query))
                out["query_id"].append(np.full(len(at), query_id))
                out["row"].append(own[at])
                out["vec_id"].append(ids[at])
                out["score"].append(line[at])
        return pd.DataFrame({n: np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for n, v in out.items()})

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = SCALE,
) -> DataFrame:
    """The k highest integer inner products of each query with every other vector.

    Components become floor(scale * x). Returns query_id, rank (from 1), vec_id,
    score; ties go to the smaller id; a query with fewer candidates gets all.
    Null ids, and vectors that are null, empty or hold null or non-finite
    components, take no part; vectors of another length are no candidates.
    Every row is a vector of its own: a repeated row is a candidate of the
    others, and a repeated query row has results of its own. An empty table
    gives no rows. Extra columns are not read.
    """
    base = vectors.where(F.col(id_col).isNotNull() & shared.finite_vector(vector_col)).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    )
    # Written once, so that the row numbers stay the same when a task is run again.
    base = shared.materialize(base.withColumn("row", F.monotonically_increasing_id()))
    counts = base.agg(F.count("*").alias("n"), F.count_if("q").alias("nq")).first()
    shards = max(1, -(-counts["n"] // SHARD))
    blocks = max(1, -(-counts["nq"] // QUERY_BLOCK))
    place = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = base.where("q").select("row", "vec_id", "v", "q", place(blocks, 1).alias("block"), each(shards).alias("shard"))
    shard = base.select("row", "vec_id", "v", F.lit(False).alias("q"), each(blocks).alias("block"), place(shards, 2).alias("shard"))
    tiles = queries.unionByName(shard).groupBy("block", "shard").applyInPandas(
        _tile(k), "query long, query_id long, row long, vec_id long, score long"
    )
    order = [F.col("score").desc(), F.col("vec_id").asc(), F.col("row").asc()]
    salted = tiles.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(min(MERGE_SALTS, shards))))
    merged = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("rank") <= k)
    final = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return final.select("query_id", "rank", "vec_id", "score")
