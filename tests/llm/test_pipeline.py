"""The pipeline's stages against brute force."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from lathe.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixing_stage_keeps_the_copies_of_repeated_rows(spark):
    rows = [(None, f"w{i} " + "w " * 9, "en", "a", 20) for i in range(40)] + [(7, "x " * 10, "en", "b", 20)] * 30
    rows += [(100 + i, "y " * (i % 5 + 1), "en", "c", 9) for i in range(60)] + [(300, None, None, None, None)]
    d = spark.createDataFrame(rows, DOCS).withColumn("copies", F.lit(9)).withColumn("extra", F.lit(9))
    want, rounded = collections.Counter(), {}
    for r in mixing.mix(d).collect():
        want[r["source"]] += r["taken"]
        rounded[r["source"]] = r["target"]
    out = corpus_pipeline.mix_sources(spark, d, "").collect()
    got = collections.Counter()
    for r in out:
        got[r["source"]] += len((r["text"] or "").split())
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}
    assert all(abs(got[s] - t) <= 10 for s, t in rounded.items())
    assert sum(r["source"] is None for r in out) == 1
    least = {k: min(c) for k, c in (("a", [r["copies"] for r in mixing.mix(d).where("source = 'a'").collect()]),)}
    times = collections.Counter(r["text"] for r in out if r["source"] == "a")
    assert all(least["a"] <= n <= least["a"] + 1 for n in times.values())


def table(spark):
    import random

    def words(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice(["ba", "ti", "ro", "en", "sha"]) for _ in range(r.randint(1, 4))) for _ in range(n))

    rows = [(i, words(i, 60), "en", "ab"[i % 2], 0) for i in range(40)]
    near = words(3, 60).split()
    near[30] = "changed"
    rows += [(50, " ".join(near), "en", "a", 0), (51, words(4, 60), "en", "b", 0), (None, words(5, 60), "en", "b", 0), (None, words(900, 60), "en", None, 0)]
    rows += [(7, words(7, 60), "en", "b", 0), (8, words(901, 60), "en", "a", 0), (60, None, None, None, None), (61, "", "en", "a", 0), (62, "12 34 56", "en", "a", 0)]
    return spark.createDataFrame(rows, DOCS).withColumn("__key", F.lit(1)).withColumn("score", F.lit("clash"))


def test_near_dedup_stage_keeps_one_document_of_each_group(spark):
    d = table(spark)
    documents = sorted({(r["doc_id"], r["text"]) for r in d.collect()}, key=str)
    shingles = lambda t: {tuple((t or "").split()[i : i + 5]) for i in range(max(len((t or "").split()) - 4, 1 if (t or "").split() else 0))}
    sets = [shingles(t) for _, t in documents]
    group = list(range(len(documents)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    out = corpus_pipeline.drop_near_copies(spark, d, "")
    assert out.columns == corpus_pipeline.COLUMNS
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(group[documents.index(x)] for x in kept) == sorted(set(group))
    assert corpus_pipeline.drop_near_copies(spark, d.limit(0), "").count() == 0


def test_filtering_stages_equal_their_operators(spark, tmp_path):
    from lathe.llm import langid, quality

    d = table(spark)
    junk = spark.createDataFrame([(100 + i, "BUY!! NOW!! " * 20, "en", "a", 0) for i in range(20)], DOCS)
    d = d.select(*corpus_pipeline.COLUMNS).unionByName(junk)
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(20)] + [(None, 0)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    count = lambda rows: collections.Counter((r["doc_id"], r["text"]) for r in rows)
    scored = quality.score(d, quality.fit(d, labels, corpus_pipeline.remainder("doc_id", 5) != 0), column="s").collect()
    got = corpus_pipeline.keep_quality(spark, d.withColumn("score", F.lit(1)), str(tmp_path))
    assert count(got.collect()) == count(r for r in scored if r["s"] >= 0.3)
    assert not any("BUY" in (r["text"] or "") for r in got.collect())
    marked = langid.identify(d).collect()
    ids = {r["doc_id"] for r in marked if not r["rejected"]}
    kept = corpus_pipeline.keep_language(spark, d, "").collect()
    assert {r["doc_id"] for r in kept} == ids and not {60, 61, 62} & {r["doc_id"] for r in kept}


def test_last_stage_encodes_every_row(spark):
    d = table(spark)
    out = corpus_pipeline.to_pieces(spark, d, "").collect()
    assert len(out) == d.count() and all(r["round_trip"] or r["ids"] is None for r in out)


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "mixing", "sentencepiece"]
