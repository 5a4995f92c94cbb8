"""Corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.llm import langid, minhash, mixing, quality, sentencepiece
from lathe.llm.shared import materialize, read, remainder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects (score below 0.3).

    Null and empty texts are scored as texts without features; rows are judged
    each, whatever their id; nothing to learn from gives 0.5 to all and drops none.
    """
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels, remainder("doc_id", 5) != 0)
    scored = quality.score(docs.select(*COLUMNS), model, column="__score")
    return scored.where(F.col("__score") >= quality.THRESHOLD).select(*COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: no letters (null and empty texts too), or far from every language.

    Rows are judged each, whatever their id; without any known language all are dropped.
    """
    model = langid.fit(docs, remainder("doc_id", 4) != 2)
    marked = langid.predict(docs.select(*COLUMNS), model, columns=("__lang", "__score", "__rejected"))
    return marked.where(~F.col("__rejected")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies.

    A document is an id with a text: its hash stands for it, so an id with
    several texts is several documents, a null id is no obstacle, and repeated
    rows are one. Texts without words are alone; of their repeated rows one stays.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("__key"))
    groups = materialize(minhash.near_duplicates(keyed, id_col="__key"))
    chosen = groups.where("kept").groupBy(F.col("doc_id").alias("__key")).agg(F.count("*").alias("__n"))
    kept = keyed.join(chosen, "__key")
    if not chosen.where("__n > 1").isEmpty():
        rest = kept.where("__n > 1").groupBy("__key").agg(F.min(F.struct(*COLUMNS)).alias("__row"))
        kept = kept.where("__n = 1").select(*COLUMNS).unionByName(rest.select("__row.*"))
    return kept.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their target weights.

    Rows of one id, source and size share the copies of their unit: all take
    the same number, and the first ones (in order of input partition, then
    text) one more. Numbers are given within partitions, so that a common id
    comes to no single task.
    """
    units = materialize(mixing.mix_units(docs).select("doc_id", F.col("source").alias("__source"), F.col("size").alias("__size"), "times", F.col("copies").alias("__copies")))
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    left, right = docs.select(*COLUMNS, size.alias("__n"), F.spark_partition_id().alias("__part")).alias("l"), units.alias("r")
    same = (
        F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
        & F.col("l.source").cast("string").eqNullSafe(F.col("r.__source"))
        & (F.col("l.__n") == F.col("r.__size"))
    )
    joined = left.join(right, same).select(*[F.col(f"l.{c}") for c in COLUMNS], "__n", "__part", "times", "__copies")
    extra = F.col("__copies") % F.col("times")
    out = joined.where(extra == 0)
    out = out.select(*COLUMNS, (F.col("__copies") / F.col("times")).cast("long").alias("copies"))
    if not units.where(extra > 0).isEmpty():
        unit = ["doc_id", "source", "__n"]
        uneven = joined.where(extra > 0)
        before = uneven.groupBy(*unit, "__part").agg(F.count("*").alias("rows"))
        earlier = Window.partitionBy(*unit).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        before = before.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).alias("b")
        numbered = uneven.withColumn("nth", F.row_number().over(Window.partitionBy(*unit, "__part").orderBy("text", "lang", "n_chars"))).alias("u")
        again = F.col("u.__part") == F.col("b.__part")
        for c in unit:
            again = again & F.col(f"u.{c}").eqNullSafe(F.col(f"b.{c}"))
        more = (F.col("nth") + F.col("before") <= F.col("__copies") % F.col("times")).cast("long")
        shared_out = numbered.join(before, again).select(*[F.col(f"u.{c}") for c in COLUMNS], (F.floor(F.col("__copies") / F.col("times")) + more).cast("long").alias("copies"))
        out = out.unionByName(shared_out)
    return out.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of every document, with a check that they decode to the text; null texts have null ids."""
    return sentencepiece.tokenize(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", to_pieces),
]

#: No stage is expressible in SQL; tests hold the stages against brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs = read(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
