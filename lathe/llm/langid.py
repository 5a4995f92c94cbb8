"""Language identification by nearest centroid.

Texts become unit TF-IDF vectors of hashed byte n-grams. Each language has
several centroids, clustered by spherical k-means on a bounded sample of its
labelled texts; the frequencies behind the weights are counted over all texts
of the training part. A text gets the language of the most similar centroid.
A text further from its centroid than nearly all training texts of that
centroid are is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams, shared

DIMS = 4096
ORDERS = (1, 2, 3)
#: Labelled texts per language that the centroids are fitted on, about.
SAMPLE = 800
CENTROIDS = 4
UNKNOWN = "und"
#: A text is rejected below this share of the distance quantile's similarity.
QUANTILE, LENIENCE = 0.001, 0.5


def _terms(texts: list[str | None]):
    """Blocks of counts of byte n-grams, A-Z lowered."""
    return ngrams.counts(texts, DIMS, ORDERS, True)


@dataclass
class Centroids:
    weights: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floor: np.ndarray


def _spherical(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Cluster unit rows by cosine; deterministic starts far from each other."""
    centres = [x.mean(axis=0)]
    near = x @ centres[0]
    for _ in range(min(k, len(x)) - 1):
        pick = int(near.argmin())
        centres.append(x[pick])
        near = np.maximum(near, x @ x[pick])
    c = np.array(centres)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Fit on rows where ``training`` holds, the text has a letter and the language is known."""
    known = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    per_lang = sorted((r[0], r[1]) for r in known.groupBy(F.col(lang_col).cast("string")).count().collect())
    if not per_lang:
        return Centroids(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    df, n = ngrams.document_frequency(known, text_col, DIMS, _terms)
    weights = ngrams.idf(df, n)
    rates = F.create_map(*[F.lit(v) for lang, c in per_lang for v in (lang, ngrams.sample_rate(c, SAMPLE))])
    # Equal texts count once, so that no common id or text brings more than its share.
    some = known.where(ngrams.sampled([id_col, text_col], rates[F.col(lang_col).cast("string")], 5) & F.col(text_col).rlike(r"\p{L}")).dropDuplicates([lang_col, text_col])

    @shared.tidy
    def features(batches):
        for batch in batches:
            for lo, hi, c in _terms(batch[text_col].tolist()):
                x = ngrams.weigh(c, weights).astype(np.float16)
                yield pd.DataFrame({"lang": batch[lang_col].iloc[lo:hi].to_numpy(), "x": [r.tobytes() for r in x]})

    rows = some.select(F.col(lang_col).cast("string").alias(lang_col), text_col).mapInPandas(features, "lang string, x binary").toPandas()
    centroids, langs, floor = [], [], []
    for lang, group in sorted(rows.groupby("lang"), key=lambda g: g[0]):
        x = np.array([np.frombuffer(b, np.float16) for b in sorted(group["x"])], dtype=np.float32)
        c = _spherical(x, CENTROIDS)
        own = (x @ c.T).max(axis=1)
        centroids.append(c)
        langs += [lang] * len(c)
        floor += [float(np.quantile(own, QUANTILE)) * LENIENCE] * len(c)
    if not centroids:
        return Centroids(weights, np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    return Centroids(weights, np.vstack(centroids).astype(np.float32), langs, np.array(floor))


def predict(docs: DataFrame, model: Centroids, text_col: str = "text", columns: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Adds the predicted language, the cosine to its centroid (0 to 1) and the rejection.

    A text that is null or has no letter gets ``und``, score 0 and is rejected.
    The model has a fixed number of dimensions and a few centroids a language.
    """
    pred, score, rejected = columns
    if {*columns, "__has_letter"} & set(docs.columns):
        raise ValueError("the new columns must not clash with columns of the table")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    schema = ", ".join([*fields, f"`{pred}` string", f"`{score}` double", f"`{rejected}` boolean"])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    letters = "__has_letter"

    @shared.tidy
    def run(batches):
        m = sent.value
        for batch in batches:
            for lo, hi, c in _terms(batch[text_col].tolist()):
                part = batch.iloc[lo:hi]
                ok = part[letters].to_numpy()
                if m.langs:
                    cos = ngrams.weigh(c, m.weights) @ m.centroids.T
                    best = cos.argmax(axis=1)
                    value = np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0, 1)
                    lang = [m.langs[b] if k else UNKNOWN for b, k in zip(best, ok)]
                    low = value < m.floor[best]
                else:
                    value, lang, low = np.zeros(hi - lo), [UNKNOWN] * (hi - lo), np.ones(hi - lo, bool)
                yield part.drop(columns=letters).assign(**{pred: lang, score: np.where(ok, value, 0.0), rejected: low | ~ok})

    marked = docs.withColumn(letters, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInPandas(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row, learning from rows not held out.

    Rows whose crc32 of the id, modulo 4, is 2 are held out. Nulls in any
    column are allowed; repeated rows are predicted each; with nothing to learn
    from, every text is ``und``; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = F.coalesce(shared.remainder("doc_id", 4) == 2, F.lit(False))
    model = fit(slim, ~held)
    return predict(slim.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
