"""Quality classification by nearest-neighbour voting on latent-semantic vectors.

Texts become TF-IDF vectors of hashed terms: byte n-grams, and words' shapes
(how many capitals, small letters, digits and other signs, and whether the word
repeats one just before it), single and in pairs. All terms are weighted alike,
by their frequency in all documents; a truncated singular value decomposition of a bounded labelled sample gives the
latent space. The sample's latent vectors and labels are broadcast (the bound
is SAMPLE), and the cosine of every document with every one of them is computed
exactly, in blocks. The nearest NEIGHBOURS vote, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams, shared

DIMS = 4096
#: Dimensions of the word shapes.
SHAPES = 512
ORDERS = (2, 3)
#: Labelled rows that the model is fitted on, about, half of them of each label.
SAMPLE = 4096
RANK = 64
NEIGHBOURS = 25
THRESHOLD = 0.3
#: How strongly similarity decides a vote.
SHARPNESS = 8.0


@dataclass
class Latent:
    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def shapes(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed word shapes and of pairs of neighbouring ones, per text."""
    out = np.zeros(len(texts) * SHAPES)
    for buffer, starts, docs in shared.pieces(texts):
        raw, first, last, doc, h = shared.words(buffer, starts, docs)
        if not len(h):
            continue
        within = lambda x: (lambda c: c[last] - c[first])(np.append(0, np.cumsum(x)))  # noqa: B023,E731
        upper = within((raw >= 65) & (raw <= 90))
        lower = within(((raw >= 97) & (raw <= 122)) | (raw >= 128))
        digits = within((raw >= 48) & (raw <= 57))
        others = last - first - upper - lower - digits
        code = np.minimum(upper, 3) + 4 * np.minimum(lower, 2) + 12 * np.minimum(digits, 2) + 36 * np.minimum(others, 3)
        for back in (1, 2):
            if len(h) > back:
                code[back:] += 144 * back * ((h[back:] == h[:-back]) & (doc[back:] == doc[:-back]))
        pair = doc[1:] == doc[:-1]
        for mark, shape, of in ((1, code, doc), (2, (code[:-1] * 1009 + code[1:])[pair], doc[1:][pair])):
            slot = shared.mix64(shape.astype(np.uint64) + np.uint64(mark * 1_000_000_000)) % np.uint64(SHAPES)
            out += np.bincount(of * SHAPES + slot.astype(np.int64), minlength=len(out))
    return out.reshape(len(texts), SHAPES).astype(np.float32)


def terms(texts: list[str | None]):
    """(first row, last row, counts of byte n-grams and word shapes) of blocks of texts."""
    for lo, hi, c in ngrams.counts(texts, DIMS, ORDERS, False):
        yield lo, hi, np.hstack([c, shapes(texts[lo:hi])])


def features(texts: list[str | None], weights: np.ndarray):
    """(first row, last row, unit feature rows) of blocks of texts."""
    for lo, hi, c in terms(texts):
        yield lo, hi, ngrams.weigh(c, weights)


def _right_vectors(x: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors by subspace iteration, in memory of a few copies of ``x``."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v[:rank].T).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Latent:
    """Fit on labelled rows where ``training`` (over the label table's id) holds."""
    df, n = ngrams.document_frequency(docs, text_col, DIMS + SHAPES, terms)
    weights = ngrams.idf(df, n)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & training).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")
    ).distinct()
    sizes = {r[0]: r[1] for r in usable.groupBy("__label").count().collect()}
    empty = Latent(weights, np.zeros((DIMS + SHAPES, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), 0.5)
    if not sizes:
        return empty
    rates = F.create_map(*[F.lit(v) for k, c in sorted(sizes.items()) for v in (k, ngrams.sample_rate(c, SAMPLE // 2))])
    # About SAMPLE ids at most, whatever the number of labels: small enough to broadcast.
    some = usable.where(ngrams.sampled(["__id"], rates[F.col("__label")], 11))
    picked = docs.select(id_col, text_col).join(F.broadcast(some), F.col(id_col) == F.col("__id")).select("__id", "__label", F.col(text_col).alias("__text"))
    # An id may have many rows: equal texts count once, and of different ones no more than wanted are drawn.
    rows_of = {r[0]: r[1] for r in picked.groupBy("__label").count().collect()}
    if any(c > SAMPLE for c in rows_of.values()):
        again = F.create_map(*[F.lit(v) for k, c in sorted(rows_of.items()) for v in (k, ngrams.sample_rate(c, SAMPLE // 2))])
        picked = picked.where(ngrams.sampled(["__id", "__text"], again[F.col("__label")], 13))
    picked = picked.dropDuplicates(["__label", "__text"])

    @shared.tidy
    def run(batches):
        for batch in batches:
            for lo, hi, x in features(batch["__text"].tolist(), weights):
                yield pd.DataFrame({"id": batch["__id"].iloc[lo:hi], "label": batch["__label"].iloc[lo:hi], "x": [r.tobytes() for r in x.astype(np.float16)]})

    rows = picked.mapInPandas(run, "id long, label int, x binary").toPandas().sort_values(["id", "label", "x"])
    if not len(rows):
        return empty
    x = np.array([np.frombuffer(b, np.float16) for b in rows["x"]], dtype=np.float32)
    y = rows["label"].to_numpy(dtype=np.float64)
    basis = _right_vectors(x, RANK)
    latent = x @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    share = sizes.get(1, 0) / sum(sizes.values())
    return Latent(weights, basis, latent, y, share)


def vote(model: Latent, x: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors."""
    if not len(model.labels):
        return np.full(len(x), model.prior)
    q = x @ model.basis
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    cos = q @ model.vectors.T
    k = min(NEIGHBOURS, cos.shape[1])
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64) ** SHARPNESS + 1e-9
    return (w * model.labels[near]).sum(axis=1) / w.sum(axis=1)


def score(docs: DataFrame, model: Latent, text_col: str = "text", column: str = "score") -> DataFrame:
    """Adds a score from 0 to 1; empty and null texts are scored as texts without features."""
    if column in docs.columns:
        raise ValueError("the new column must not clash with a column of the table")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @shared.tidy
    def run(batches):
        m = sent.value
        for batch in batches:
            for lo, hi, x in features(batch[text_col].tolist(), m.weights):
                yield batch.iloc[lo:hi].assign(**{column: np.clip(vote(m, x), 0, 1)})

    return docs.mapInPandas(run, ", ".join([*fields, f"`{column}` double"]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, learning from label rows not held out.

    Rows whose crc32 of the id, modulo 5, is 0 are held out. Labels other than
    0 and 1 and null ids in the label table are ignored; an id with both labels
    votes both ways. Repeated rows are scored each; without labels every score
    is 0.5; an empty table gives no rows. Extra columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = labels.select(F.col(id_col).alias("doc_id"), F.col("quality"))
    model = fit(slim, names, shared.remainder("doc_id", 5) != 0)
    held = (shared.remainder("doc_id", 5) == 0).alias("held_out")
    out = score(slim.select("doc_id", held, "text"), model).drop("text")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
