"""Embedding near-dedup: exact metric range join over pivot cells.

Unit vectors are assigned to their nearest pivot of the same label. The
triangle inequality bounds how far from the border between two cells a partner
can lie, so each vector is also copied to every cell within that bound; each
cell then finds all partners of its own vectors by itself. Cells are cut into
blocks of bounded size. Inside a block only a spanning forest of the links is
emitted, beside the exact number of links of each vector.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import components

COSINE = 0.93
#: Distinct vectors of a label per pivot; pivots of one label, and of all labels, at most.
PER_PIVOT = 4096
MAX_PIVOTS = 256
ALL_PIVOTS = 16384
#: Vectors on either side of one block.
BLOCK = 2048
SLACK = 1e-9


def _unit(vectors: list) -> np.ndarray:
    """Unit rows; each is scaled by its largest component first, so that no square over- or underflows."""
    m = shared.matrix(vectors)
    m = m / np.abs(m).max(axis=1)[:, None]
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _assign(pivots: dict, threshold: float):
    """Home cell and replicas of each vector; parts without pivots are one cell."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    gaps = {key: np.sqrt(np.maximum(0, 2 - 2 * p @ p.T)) for key, p in pivots.items()}

    @shared.tidy
    def run(batches):
        for batch in batches:
            ids, cells, home, keys, vecs, ns = [], [], [], [], [], []
            for key, part in batch.groupby("part", sort=False):
                p = pivots.get(key)
                if p is None:
                    ids.append(part["cid"].to_numpy())
                    ns.append(part["n"].to_numpy())
                    cells.append(np.zeros(len(part), np.int64))
                    home.append(np.ones(len(part), bool))
                    keys.append(np.full(len(part), key, dtype=object))
                    vecs += part["v"].tolist()
                    continue
                unit = _unit(part["v"].tolist())
                cos = unit @ p.T
                near = cos.argmax(axis=1)
                margin = cos[np.arange(len(part)), near][:, None] - cos
                hit = margin <= radius * gaps[key][near] + SLACK
                hit[np.arange(len(part)), near] = True
                r, c = np.nonzero(hit)
                values = part["v"].tolist()
                ids.append(part["cid"].to_numpy()[r])
                ns.append(part["n"].to_numpy()[r])
                cells.append(c)
                home.append(c == near[r])
                keys.append(np.full(len(r), key, dtype=object))
                vecs += [values[i] for i in r]
            if vecs:
                yield pd.DataFrame({"part": np.concatenate(keys), "cell": np.concatenate(cells).astype(np.int32), "cid": np.concatenate(ids), "n": np.concatenate(ns), "home": np.concatenate(home), "v": vecs})

    return run


def _join(threshold: float):
    """All links between the own vectors of a block and one block of its cell."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        own, other = block[block["mine"]], block[~block["mine"]]
        if not len(own) or not len(other):
            return pd.DataFrame({"cid": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        a, b = _unit(own["v"].tolist()), _unit(other["v"].tolist())
        ai, bi, bn = own["cid"].to_numpy(), other["cid"].to_numpy(), other["n"].to_numpy()
        hit = a @ b.T >= threshold
        hit &= ai[:, None] != bi[None, :]
        links = hit @ bn
        root_a, root_b = _smallest(hit, ai, bi)
        mine, theirs = links > 0, (root_b < bi) & hit.any(axis=0)
        return pd.DataFrame(
            {
                "cid": np.concatenate([ai[mine], bi[theirs]]),
                "links": np.concatenate([links[mine], np.zeros(theirs.sum(), np.int64)]),
                "root": np.concatenate([root_a[mine], root_b[theirs]]),
            }
        ).astype(np.int64)

    return run


def _smallest(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column reaches by the links of a block, in rounds over the whole block.

    A vector that stands on both sides has one label, so both sides are matched by id between the rounds.
    """
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = ids.copy()
    none = np.iinfo(np.int64).max
    linked = hit.any(axis=1)
    ia, ib, hit = at[: len(a)][linked], at[len(a) :], hit[linked]
    while True:
        before = label.copy()
        np.minimum.at(label, ia, np.where(hit, label[ib][None, :], none).min(axis=1, initial=none))
        np.minimum.at(label, ib, np.where(hit, label[ia][:, None], none).min(axis=0, initial=none))
        label = np.minimum(label, label[np.searchsorted(ids, label)])
        if (label == before).all():
            return label[at[: len(a)]], label[at[len(a) :]]


def dedup_vectors(
    vectors: DataFrame,
    threshold: float = COSINE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Links by cosine >= threshold among rows of equal, non-null label.

    Returns one row per input row: vec_id, n_links (other rows linked
    directly), component_id (smallest vec_id reachable), kept. Vectors that are
    null, zero, or hold null or non-finite components, rows of null label or
    null id, link with nothing. Only vectors of one length are compared.
    Repeated rows count as further vectors that link with each other. An empty
    table gives no rows; extra columns are not read. Only pivots go to the
    driver and to all tasks, at most ALL_PIVOTS whatever the number of labels;
    labels too small for two pivots are one cell each.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"),
    )
    usable = shared.finite_vector("v") & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    part = F.concat_ws("|", F.size("v").cast("string"), F.col("label"))
    good = rows.where(usable).select("vec_id", part.alias("part"), "v")
    classes = shared.materialize(
        good.groupBy("part", "v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"))
    )
    total = classes.count()
    per_pivot = max(PER_PIVOT, -(-total // ALL_PIVOTS))
    # Every label with two pivots has as many times per_pivot vectors, which bounds their sum by ALL_PIVOTS.
    wanted = classes.groupBy("part").agg(F.least(F.floor(F.count("*") / per_pivot), F.lit(MAX_PIVOTS)).alias("want")).where("want > 1")
    placed = classes.join(wanted, "part").withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("v"), "cid")))
    picked: dict[str, list] = defaultdict(list)
    for r in placed.where(F.col("nth") <= F.least("want", F.lit(MAX_PIVOTS))).where(F.col("nth") <= MAX_PIVOTS).select("part", "nth", "v").orderBy("part", "nth").toLocalIterator():
        picked[r["part"]].append(r["v"])
    picked = {part: _unit(vectors) for part, vectors in picked.items()}
    slim = classes.select("part", "cid", "n", "v")
    cells = shared.materialize(
        slim.mapInPandas(_assign(picked, threshold), "part string, cell int, cid long, n long, home boolean, v array<double>")
    )
    shape = cells.groupBy("part", "cell").agg(
        F.ceil(F.count_if("home") / BLOCK).cast("int").alias("rows_n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("cols_n")
    )
    dealt = cells.join(shape, ["part", "cell"]).where("rows_n > 0")
    place = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = dealt.where("home").select("part", "cell", "cid", "n", "v", F.lit(True).alias("mine"), place("rows_n", 3).alias("i"), each("cols_n").alias("j"))
    other = dealt.select("part", "cell", "cid", "n", "v", F.lit(False).alias("mine"), each("rows_n").alias("i"), place("cols_n", 4).alias("j"))
    block = ["part", "cell", "i", "j"]
    found = shared.materialize(
        own.unionByName(other).groupBy(*block).applyInPandas(_join(threshold), "cid long, links long, root long")
    )
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    state = (
        classes.select("part", "v", "cid", "n")
        .join(links, "cid", "left")
        .join(groups.withColumnRenamed("id", "cid"), "cid", "left")
        .select("part", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    )
    linked = good.join(state, ["part", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
