"""Edge cases of the operators, and whole queries against brute force or SQL."""

import collections
import math
import os
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe.llm import edits, html, langid, lm, mixing, quality, queries, topk, vectordedup
from tests.llm.test_operators import DOCS, brute_suffix_tree, words

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    r = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    got = queries.QUERIES[name](spark, DATA).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(r.fetchall())


def test_vector_sql_on_hard_rows(spark):
    """Repeated rows, nulls, zero, tiny and huge vectors: operator and SQL agree."""
    r = np.random.default_rng(7)
    near = [1.0, 0.2, 0.0]
    rows = [(i, [float(x) for x in r.normal(size=3)], i % 2) for i in range(100, 130)]
    rows += [(0, near, 1), (1, near, 1), (1, near, 1), (2, [1.0, 0.21, 0.0], 1), (3, [1e-200, 2e-201, 0.0], 1), (4, [1e200, 2e199, 0.0], 1), (5, [0.0, 0.0, 0.0], 1)]
    rows += [(6, None, 1), (7, [], 1), (8, [1.0, None, 0.0], 1), (9, [1.0, float("nan"), 0.0], 1), (10, [1.0, float("inf"), 0.0], 1), (11, near, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    c = duckdb.connect()
    c.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INT)")
    c.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    want = c.execute(queries.ORACLE_SQL["op6_embedding_dedup"]).fetchall()
    got = vectordedup.dedup_vectors(df).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    links = {x["vec_id"]: x["n_links"] for x in got}
    assert links[3] == links[4] == links[0] == 5 and links[5] == links[11] == 0
    small = df.where("vec_id NOT IN (3, 4)")
    c.execute("DELETE FROM embeddings WHERE vec_id IN (3, 4)")
    want = c.execute(queries.ORACLE_SQL["op5_exact_topk"]).fetchall()
    assert sorted(map(tuple, topk.top_k(small, F.col("vec_id") % 100 == 0).collect())) == sorted(want)


def test_top_k_keeps_repeated_rows(spark):
    rows = [(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 0, 3).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got)] == [(1, 1), (2, 1), (3, 2)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0 and vectordedup.dedup_vectors(df.limit(0).withColumn("label", F.lit(1))).count() == 0


def test_pages_meet_their_nearest_page(spark):
    """Partner choice and differencing against brute force over all pages of a host."""
    r = random.Random(3)
    rows = []
    for i in range(60):
        path = "/".join(r.choice("ab") * r.randint(1, 2) for _ in range(3))
        menu = "".join(f"<li>{x}</li>" for x in r.sample(["home", "news", "shop", "help"], 3))
        rows.append((i, f"https://{r.choice('xyz')}.example/{path}?{i}", f"<body><nav><ul>{menu}</ul></nav><div>{r.choice(['one', 'two'])}</div><p>text {i}</p></body>"))
    rows += [(3, rows[3][1], rows[3][2]), (70, None, "<p>alone"), (71, rows[0][1], None)]
    got = collections.Counter((x["page_id"], x["text"], x["n_template_lines"]) for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    keyed = []
    for i, url, page in rows:
        bare = (url or "").split("://")[-1].split("?")[0]
        host, _, path = bare.partition("/")
        keyed.append((host.encode(), path.encode(), i, page))
    keyed.sort(key=lambda x: x[:3])
    want = collections.Counter()
    for at, (host, path, i, page) in enumerate(keyed):
        best = None
        for other in keyed[max(at - 1, 0) : at] + keyed[at + 1 : at + 2]:
            if other[0] == host:
                near = len(os.path.commonprefix([other[1].decode(), path.decode()]))
                if best is None or near > best[0]:
                    best = (near, other)
        text, n = html.main_text(html.all_lines(page), html.all_lines(best[1][3]) if best else [])
        want[(i, text, n)] += 1
    assert got == want and sum(n for *_, n in got) > 60


def test_html_titles_quotes_and_depth():
    assert html.lines("<article><header><h1>Title</h1></header><p>a</p></article>") == [("Title", True), ("a", True)]
    assert html.lines('<p class="x>hello') == [("hello", False)]
    began = time.time()
    html.lines("<div>" * 20000 + "</span>" * 20000)
    html.lines('<a "' * 20001)
    assert time.time() - began < 5


def test_stored_trees_take_further_edits(spark):
    texts = [" ".join(words(i, 300)) for i in range(6)] + ["", None, "é" * 300]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    edit = lambda a, b, s: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(s).alias("new")))
    trees = edits.build_trees(d)
    once = edits.apply_edits(trees, edit(5, 9, " new words " * 300))
    twice = {r["doc_id"]: r for r in edits.apply_edits(once, edit(40, 44, "x")).collect()}
    with open(edits.VOCABULARY, "rb") as f:
        counter = edits.Counter(f.read())
    for i, t in enumerate(texts):
        t = t or ""
        t = t[:5] + " new words " * 300 + t[9:]
        t = t[:40] + "x" + t[44:]
        assert twice[i]["text"] == t and twice[i]["n_tokens"] == len(counter.encoding.encode_ordinary(t)) and twice[i]["n_recut"] < 12
    nothing = F.lit(None).cast("array<struct<start:int,stop:int,new:string>>")
    same = {r["doc_id"]: r for r in edits.count_edits(d, nothing).collect()}
    assert all(same[i]["n_tokens"] == same[i]["n_tokens_edited"] and same[i]["n_recut"] == 0 for i in range(len(texts)))
    assert edits.count_edits(d.limit(0), nothing).count() == 0


def test_a_long_insert_is_cut_into_leaves():
    with open(edits.VOCABULARY, "rb") as f:
        counter = edits.Counter(f.read())
    tree = edits.SegmentTree(counter, "a b c", leaf=4)
    tree.edit(2, 3, " word" * 1000)
    assert max(map(len, tree.pieces)) <= 8 and tree.total == len(counter.encoding.encode_ordinary(tree.text))
    assert edits.SegmentTree(counter, tree.text, stored=tree.store()).total == tree.total


def test_mixing_shares_copies_of_a_common_id(spark):
    rows = [(None, "w " * (i % 3 + 1), "en", "a", 0) for i in range(900)] + [(7, "x x", "en", "b", 0)] * 500 + [(i, "y " * (i % 9), "en", None, 0) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    taken, target, by = collections.Counter(), {}, collections.defaultdict(set)
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        by[(r["doc_id"], r["source"], r["size"])].add(r["copies"])
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - t) <= 9 for s, t in target.items())
    assert all(max(c) - min(c) <= 1 for c in by.values())


def test_classifiers_on_empty_tables_and_clashes(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert langid.identify(none).count() == 0 and quality.classify(none, labels).count() == 0
    some = spark.createDataFrame([(i, "ab cd ef " * 5, "en", "s", 0) for i in range(30)], DOCS)
    got = langid.identify(some.withColumn("score", F.lit(1)).withColumn("rejected", F.lit(1)))
    assert set(got.columns) == {"doc_id", "held_out", "lang_pred", "score", "rejected"} and got.count() == 30
    with pytest.raises(ValueError):
        langid.predict(some.withColumn("score", F.lit(1)), langid.fit(some, F.lit(True)))
    with pytest.raises(ValueError):
        quality.score(some.withColumn("score", F.lit(1)), None)


def test_a_common_id_does_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 20)
    rows = [(1, "same words again", "en", "s", 0)] * 600 + [(1, " ".join(words(i, 9)), "en", "s", 0) for i in range(600)]
    seen = []
    spherical = langid._spherical
    monkeypatch.setattr(langid, "_spherical", lambda x, k: (seen.append(len(x)), spherical(x, k))[1])
    langid.fit(spark.createDataFrame(rows, DOCS), F.lit(True))
    assert 0 < seen[0] < 60


def test_word_shapes_tell_marks_and_repeats():
    a, b, c = quality.shapes(["plain words here", "LOUD!! WORDS!! HERE!!", "same same same"])
    assert (a != b).any() and (a != c).any() and a.sum() == b.sum() == 5
    assert quality.shapes([None, ""]).sum() == 0


def test_states_of_the_suffix_tree_sum_to_one():
    """Over all known tokens and one unknown, the probabilities of every retained state add up to 1."""
    texts = [" ".join(random.Random(i % 7).choice(["of", "to"]) + " the " + w for w in words(i % 7, 12)) for i in range(40)]
    train = [[*t.split(), None] for t in texts]
    _, kept = brute_suffix_tree(train, [])
    assert kept
    count = collections.Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    follow = collections.defaultdict(collections.Counter)
    for t in train:
        for i in range(1, len(t)):
            for k in range(1, min(lm.DEPTH, i) + 1):
                follow[tuple(t[i - k : i])][t[i]] += 1

    def p(context, w):
        if not context:
            return (count[w] + 0.5) / (n + 0.5 * (v + 1))
        below = p(context[1:], w)
        f = follow[context]
        return (f[w] + len(f) * below) / (sum(f.values()) + len(f)) if context in kept else below

    for context in kept:
        assert math.isclose(sum(p(context, w) for w in [*count, "unknown"]), 1, abs_tol=1e-9)
