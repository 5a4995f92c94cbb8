"""The corpus operators against brute force, round trips and edge cases."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lathe.llm import edits, html, langid, lm, minhash, mixing, ngrams, quality, sentencepiece, shared, topk, vectordedup
from lathe.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(["ba", "ti", "ro", "en", "sha"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = [" ".join(words(i, 60)) for i in range(12)]
    rows = [(i, t, "en", "a" if i % 3 else None, 0) for i, t in enumerate(base)]
    near = base[0].split()
    near[30] = "changed"
    rows += [(20, " ".join(near), "en", "b", 0), (21, base[1], "en", "b", 0), (22, None, None, None, None), (23, "", "en", "b", 0), (24, "  \n", "en", "b", 0), (25, "one two", "en", "b", 0), (26, "one two", None, "b", 0), (27, "123 456", "en", "a", 0), (3, base[3], "en", None, 0), (None, base[4], "en", "a", 0)]
    rows += [(28, "x" * 5000 + " " + "word " * 30000, "en", "a", 0)]
    return spark.createDataFrame(rows, DOCS).withColumn("id", F.lit(1)).withColumn("band", F.lit("clash"))


def test_word_hashes_cut_long_texts_at_words():
    text = " ".join(words(1, 5000))
    whole, _ = shared.word_hashes([text])
    parts = [shared.words(*b)[4] for b in shared.pieces([text], 1000)]
    assert (np.concatenate(parts) == whole).all() and len(whole) == 5000
    assert len(set(whole.tolist())) == len(set(text.split()))


def brute_viterbi(m, s):
    score = {p: (m.scores[i], i) for i, p in enumerate(m.pieces) if m.types[i] in (1, 4)}
    best = [0.0] + [-math.inf] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - 32), e):
            v = score.get(s[b:e], (m.unknown_score,) if e - b == 1 else None)
            if v:
                best[e] = max(best[e], best[b] + v[0])
    return best[-1]


def test_sentencepiece_path_and_round_trip(spark, docs):
    m = sentencepiece.Model(sentencepiece.read_model())
    for s in ("Hello world, the theory", "a\n\nb 日本 é", "   spaced  out ", "x" * 40):
        path = m.viterbi(m.normalize(s))
        total, bytes_ = 0.0, 0
        for i in path:
            if i in m.byte_of:
                bytes_ += 1
            else:
                total += m.scores[i]
        if not bytes_:
            assert total == brute_viterbi(m, m.normalize(s))
        assert m.encode(s) == list(path) and m.decode(path) == s
    rows = {r["doc_id"]: r for r in sentencepiece.tokenize(docs).collect()}
    assert rows[22]["ids"] is None and rows[22]["n_ids"] == 0 and rows[23]["ids"] == []
    assert all(r["round_trip"] for k, r in rows.items() if k != 22)
    back = sentencepiece.decode_ids(sentencepiece.tokenize(docs)).where("doc_id = 5").first()
    assert back["decoded"] == docs.where("doc_id = 5").first()["text"]


def test_html_rules(spark):
    page = "<html><head><title>t</title></head><body><header>H</header><div class='cookie-notice'>C</div><div class='page has-sidebar'><p>One&amp;<b>two</b>\n three<p>Four<br>five<ul><li>a<li>b</ul><form>f</form><script>if (a<b) x()</script><div id=comments>no</div></div><footer>F</footer>"
    assert " ".join(t for t, _ in html.lines(page)) == "One&two three Four five a b"
    assert html.difference([("top", False), ("own", False), ("end", False)], [("top", False), ("x", False), ("end", False)]) == "own"
    assert html.difference([("same", True)], [("same", True)]) == "same"
    for _ in range(50):
        a, b = [random.choice("abc") for _ in range(9)], [random.choice("abc") for _ in range(9)]
        t = [[0] * 10 for _ in range(10)]
        for i in range(9):
            for j in range(9):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert len(html.common(a, b)) == t[9][9]
    rows = [(i, f"http://h.example/{i // 3}/{i}", f"<body><div>Site</div><p>text {i}</p><div>End</div>") for i in range(40)] + [(90, None, None), (91, "", ""), (1, "http://h.example/0/1", "<body><p>text 1</p>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("part", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert by[7] == ["text 7"] and by[90] == [""] and by[91] == [""]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_compares_whole_attribute_names_and_heads_of_classes():
    inner = "<p title='The hidden garden'>A</p><p data-state=\"hidden\" data-hidden='false'>B</p><a href=\"/a/hidden-gems\">C</a><p><a href='/p?id=search' data-id=\"comments\">D</a></p>"
    for before, after in (("<article>", "</article>"), ("<div>", "</div>"), ("<div class='post social-enabled'>", "</div>"), ("<div class=content-with-sidebar>", "</div>"), ("<div class='x sidebar'><main>", "</main></div>")):
        assert " ".join(t for t, _ in html.lines(f"<body>{before}{inner}{after}</body>")) == "A B C D", before
    for mark in ("class='left-sidebar'", "id=comments-3", "hidden", "HIDDEN=''", "role=search", "aria-hidden=true", "style='display: none'"):
        assert html.lines(f"<body><div title='a=b' {mark}>N</div><p>A</p></body>") == [("A", False)], mark


def jaccard_groups(rows):
    def sh(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    s = {i: sh(t) for i, t in rows if i is not None}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in s}


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = jaccard_groups(rows)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["group_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_block_sets_keep_whole_hashes(monkeypatch):
    hashes = np.arange(10, dtype=np.uint64)
    monkeypatch.setattr(minhash, "shingles", lambda texts: (hashes, np.zeros(10, np.int64), None, None))
    (got,) = minhash._shingle_sets([pd.DataFrame({"id": [1], "text": ["x"]})])
    assert np.frombuffer(got["set"][0], np.uint64).tolist() == hashes.tolist()


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    ids = shared.mix64(np.arange(300, dtype=np.uint64))
    a, b = rng.uniform(0.2, 5, 300), rng.uniform(0.2, 5, 300)
    sig, some = minhash.dart_signatures(np.concatenate([ids, ids]), np.repeat([0, 1], 300), 2, 1024, np.concatenate([a, b]))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.06 and some.all()


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == find(x) for e in edges if e[0] != e[1] for x in e)


def test_a_bucket_of_one_block_is_not_repeated(spark):
    rows = spark.range(600).selectExpr("1L AS band", "id", "id AS component", "true AS own")
    got = minhash._blocks(rows, spark.range(600).selectExpr("id", "id AS value")).agg(F.count("*").alias("n")).collect()
    assert [r["n"] for r in got] == [600]


def test_blocks_hold_every_pair_and_join_a_member_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "OWN_BLOCK", 4)
    monkeypatch.setattr(minhash, "OTHER_BLOCK", 8)
    rows = spark.range(30).selectExpr("1L AS band", "id", "id AS component", "id % 3 = 0 AS own")
    blocks = minhash._blocks(rows, spark.range(30).selectExpr("id", "id AS value")).agg(F.collect_list(F.struct("id", "side")).alias("rows"))
    pairs = [(a["id"], b["id"]) for r in blocks.collect() for a in r["rows"] if a["side"] & 1 for b in r["rows"] if b["side"] & 2]
    assert sorted(pairs) == [(a, b) for a in range(0, 30, 3) for b in range(30)]


def test_lm_base_and_model(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tok = [[x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().translate(low)) if x] + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    c = collections.Counter(w for t, h in zip(tok, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    got = lm.score_texts(docs, shared.remainder("doc_id", 5) == 1).collect()
    want = sorted((i or -1, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)) for (i, _), t in zip(rows, tok))
    assert want == sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_texts(docs.limit(0), F.lit(False)).count() == 0


def test_lm_probabilities_of_a_state_sum_to_one(spark):
    """After the rare word a, the chances of all tokens that can follow it add up to that of the alphabet."""
    rows = [(i, f"a b{i % 2} " + " ".join(words(i, 40))) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    base = {r["doc_id"]: r for r in lm.score_texts(d, F.col("doc_id") == 1).collect()}
    assert base[0]["score"] > base[0]["base_score"]


def brute_suffix_tree(train, texts):
    """log10 of each text in the suffix tree of contexts of up to DEPTH words, of any frequency."""
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    follow = collections.defaultdict(collections.Counter)
    for t in train:
        for i in range(1, len(t)):
            for k in range(1, min(lm.DEPTH, i) + 1):
                follow[tuple(t[i - k : i])][t[i]] += 1
    kept = set()

    def p(context, w):
        if not context:
            return (c[w] + 0.5) / (n + 0.5 * (v + 1))
        below = p(context[1:], w)
        if context not in kept:
            return below
        f = follow[context]
        return (f[w] + len(f) * below) / (sum(f.values()) + len(f))

    for context, f in sorted(follow.items(), key=lambda x: len(x[0])):
        t, total = len(f), sum(f.values())
        if max(f.values()) > 1:
            below = {w: p(context[1:], w) for w in f}
            if sum(k * math.log((k - 1 + t * below[w]) / (total - 1 + t) / below[w]) for w, k in f.items()) > 1e-9:
                kept.add(context)
    score = [sum(math.log10(p(tuple(t[max(0, i - lm.DEPTH) : i]), t[i])) for i in range(len(t))) for t in texts]
    return score, kept


def test_lm_equals_a_suffix_tree_over_all_words(spark):
    texts = [" ".join(random.Random(i % 37).choice(["of", "to"]) + " the " + w for w in words(i % 37, 12)) for i in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)]
    tokens = [[*t.split(), None] for t in texts]
    want, kept = brute_suffix_tree([t for i, t in enumerate(tokens) if i % 4], tokens)
    assert any("the" in x for x in kept)
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 4 == 0).collect()}
    assert [got[i] for i in range(80)] == pytest.approx(want, abs=1e-6)


def test_lm_chunks_share_a_common_word(spark):
    """Words with more places than a chunk are split by the word before; the whole tree comes out, from packed arrays only."""
    texts = [" ".join(random.Random(i % 37).choice(["of", "to"]) + " the " + w for w in words(i % 37, 12)) for i in range(80)]
    tokens = [[*t.split(), None] for t in texts]
    want, _ = brute_suffix_tree([t for i, t in enumerate(tokens) if i % 4], tokens)
    df = lm.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id") % 4 == 0, chunk=40)
    got = {r["doc_id"]: r["score"] for r in df.collect()}
    assert [got[i] for i in range(80)] == pytest.approx(want, abs=1e-6)


def test_lm_sends_a_place_once():
    """Repeated places of a slice are one state with its times, whatever their number."""
    from types import SimpleNamespace

    sizes, numbers = np.full(500, 4), np.tile([3, 5, 7, 1], 500)
    row = pd.DataFrame([(0, np.arange(500) % 5 == 0, lm._pack(sizes), lm._pack(numbers))], columns=["slice", "held", "sizes", "numbers"])
    row["held"] = [x.tobytes() for x in row["held"]]
    none = np.zeros(0, np.int64)
    (got,) = lm._deal(SimpleNamespace(value=(none.astype(np.uint64), none, none)), 1)([row])
    w, w1, w2, nxt, trained, times = lm._unpack(got["states"].iloc[0])
    assert sorted(zip(w, w1, w2, nxt, trained, times)) == [(3, 0, 0, 5, 400, 500), (5, 3, 0, 7, 400, 500), (7, 5, 3, 1, 400, 500)]
    assert len(lm._unpack(got["docs"].iloc[0])[0]) == 1500


def test_lm_ids_stay_exact(spark):
    """Ids beyond 53 bits beside a null one."""
    rows = [(2**60 + 1, "a b"), (None, "a b"), (2**60 + 3, None)]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()
    assert {r["doc_id"] for r in got} == {2**60 + 1, None, 2**60 + 3}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(300)] + [(400, None), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] * 6), (None, [0.0] * 6), (700, [])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit(9)), F.col("vec_id") % 50 == 0, 5).collect()
    v = {i: [math.floor(1024 * x) for x in e] for i, e in rows[:300]}
    want = set()
    for q in range(0, 300, 50):
        s = sorted(((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q))[:5]
        want |= {(q, k + 1, c, -x) for k, (x, c) in enumerate(s)}
    assert {tuple(r) for r in got} == want


def test_vector_dedup(spark, monkeypatch):
    monkeypatch.setattr(vectordedup, "PER_PIVOT", 20)
    monkeypatch.setattr(vectordedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(20, 8))
    rows = [(i, [float(x) for x in centre[i % 20] + rng.normal(size=8) * 0.25], i % 2) for i in range(160)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], None), (202, None, 0), (203, [0.0] * 8, 0), (204, [float("inf")] * 8, 0)]
    got = {r["vec_id"]: r for r in vectordedup.dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = {i: np.array(e) / np.linalg.norm(e) for i, e, lab in rows if lab is not None and e and np.isfinite(e).all() and any(e)}
    label = {i: lab for i, _, lab in rows}
    near = {i: {j for j in unit if j != i and label[i] == label[j] and unit[i] @ unit[j] >= 0.93} for i in unit}
    for i in label:
        assert got[i]["n_links"] == len(near.get(i, ()))
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (i == min(seen))


def test_language_and_quality(spark, docs):
    german = ["".join(random.Random(i).choice(["sch", "ung", "keit", "ein", "zu"]) for _ in range(3)) + " der" for i in range(400)]
    rows = [(i, " ".join(words(i, 50)), "en", "s", 0) for i in range(60)] + [(100 + i, " ".join(german[i * 5 : i * 5 + 40]), "de", "s", 0) for i in range(60)]
    d = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _, _ in rows)
    edge = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert edge[22]["lang_pred"] == edge[23]["lang_pred"] == edge[27]["lang_pred"] == "und"
    junk = [(500 + i, "BUY!! NOW!! " * 30, "en", "s", 0) for i in range(30)]
    d = d.union(spark.createDataFrame(junk, DOCS))
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(500 + i, 0) for i in range(30)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(d, labels).collect()}
    assert all(got[i]["predicted"] == 1 for i in range(60)) and all(got[500 + i]["predicted"] == 0 for i in range(30))
    assert quality.classify(docs, labels.limit(0)).count() == docs.count()


def test_edits_equal_a_new_count():
    with open(edits.VOCABULARY, "rb") as f:
        counter = edits.Counter(f.read())
    r = random.Random(4)
    for text in (" ".join(words(1, 80)), "", "  \n x's  ", "é日本 12 "):
        tree = edits.SegmentTree(counter, text, leaf=r.choice([2, 8]))
        for _ in range(60):
            a = r.randint(0, len(tree.text))
            tree.edit(a, a + r.choice([0, 1, 5, 50]), r.choice(["", " ", "\n\n", "'s", " word", "12", "é "]))
            assert tree.total == len(counter.encoding.encode_ordinary(tree.text))
            assert [p for leaf in tree.pieces for p in leaf] == counter.cut.findall(tree.text)


def test_edit_query_edges(spark, docs):
    got = edits.count_edits(docs, edits.standing_edits()).collect()
    assert len(got) == docs.count()


def test_mixing(spark, docs):
    assert mixing.fair_targets([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    rows = [(i, "w " * (i % 40 + 1), "en", "abc"[i % 3], 0) for i in range(3000)]
    a = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    b = mixing.mix(spark.createDataFrame(rows[::-1], DOCS)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in a) == sorted((r["doc_id"], r["taken"]) for r in b)
    taken, target = collections.Counter(), {}
    for r in a:
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 45 for s, t in target.items())
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and mixing.mix(docs.limit(0)).count() == 0


def test_ngram_counts_do_not_join_texts():
    (_, _, c), = ngrams.counts(["ab", "cd"], 4096, (2,), False)
    (_, _, one), = ngrams.counts(["ab"], 4096, (2,), False)
    assert (c[0] == one[0]).all()
