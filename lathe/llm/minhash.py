"""MinHash near-dedup with DartMinHash signatures.

Every shingle throws hashed darts at the plane of weight and rank. The plane is
cut into cells of doubling size, each cell's darts depend on shingle and cell
alone, so two documents that share a shingle share its darts. A document looks
at the darts below its weights and below a rank that yields enough of them, and
keeps the lowest dart of each coordinate. Equal coordinates occur with the
probability of the (weighted) Jaccard similarity.

Signatures are cut into bands; documents that share a band become candidates.
A text is compared with the first member of the bucket that holds it most often,
then members of buckets that stay in other components are compared with the bucket's remaining ones inside blocks, by
their full signatures, and what passes there by the whole shingle sets.
With 40 bands of 5 coordinates a pair of similarity 0.8 shares no bucket with
probability 1.3e-7.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 5
#: Candidates whose signatures agree less are not verified: 5 standard deviations below 0.8.
ESTIMATE = 0.65
#: Rows on the two sides of one block of a bucket.
OWN_BLOCK, OTHER_BLOCK = 512, 4096
#: Sides of a row in a block; it may stand on both.
_OWN, _OTHER = 1, 2
#: Characters of the texts that a worker describes at once, or one longer text.
SLICE = 1 << 20
#: Bits of a filter of keys, at most.
FILTER_BITS = 1 << 26
_M = np.uint64(0x9E3779B97F4A7C15)
_FIRST = -6


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, their document, word hashes, their document).

    A text of fewer words than ``size`` is one shingle of all its words; a text
    without words has none.
    """
    h, doc = shared.word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    out = [np.zeros(0, np.uint64)]
    docs = [np.zeros(0, np.int64)]
    if len(h) >= size:
        m = len(h) - size + 1
        s = np.zeros(m, dtype=np.uint64)
        for i in range(size):
            s = s * _M + h[i : i + m]
        inside = doc[:m] == doc[size - 1 :]
        out.append(shared.mix64(s[inside]))
        docs.append(doc[:m][inside])
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        first = np.concatenate(([0], np.cumsum(n)))
        for d in short:
            v = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in h[first[d] : first[d + 1]]:
                    v = v * _M + x
            out.append(shared.mix64(np.array([v ^ np.uint64(n[d])], dtype=np.uint64)))
            docs.append(np.array([d], dtype=np.int64))
    return np.concatenate(out), np.concatenate(docs), h, doc


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson count."""
    top = int(mean + 12 * np.sqrt(mean) + 12)
    log = np.cumsum(np.concatenate(([-mean], np.log(mean) - np.log(np.arange(1, top + 1)))))
    return np.cumsum(np.exp(log))


def _cells(first: int):
    """(low, width) of the cells of an axis: one that starts at 0, then doubling ones."""
    yield 0.0, 2.0**first
    for j in range(first, 64):
        yield 2.0**j, 2.0**j


def _throw(element: np.ndarray, doc: np.ndarray, weight: np.ndarray | None, limit: np.ndarray):
    """(document, rank, dart) of all darts below each element's weight and its document's rank limit."""
    got_d, got_r, got_v = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.uint64)]
    bound = limit[doc]
    top_rank = bound.max(initial=0)
    top_weight = 1.0 if weight is None else weight.max(initial=0)
    for a, (w_low, w_width) in enumerate(_cells(0)):
        if w_low >= top_weight:
            break
        for b, (r_low, r_width) in enumerate(_cells(_FIRST)):
            if r_low >= top_rank:
                break
            inside = bound > r_low
            if weight is not None:
                inside &= weight > w_low
            e = element[inside]
            if not len(e):
                continue
            cell = shared.mix64(e ^ np.uint64((a * 1000 + b + 1) * 0x5851F42D4C957F2D % (1 << 64)))
            count = np.searchsorted(_poisson(w_width * r_width), (cell >> np.uint64(11)) / float(1 << 53), side="right")
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            times = count[hit]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            dart = shared.mix64(np.repeat(cell[hit], times) + (nth.astype(np.uint64) + np.uint64(1)) * _M)
            rank = r_low + r_width * ((dart >> np.uint64(11)) / float(1 << 53))
            where = np.repeat(np.flatnonzero(inside)[hit], times)
            keep = rank < bound[where]
            if weight is not None:
                at = w_low + w_width * ((shared.mix64(dart ^ _M) >> np.uint64(11)) / float(1 << 53))
                keep &= at < weight[where]
            got_d.append(doc[where[keep]])
            got_r.append(rank[keep])
            got_v.append(dart[keep])
    return np.concatenate(got_d), np.concatenate(got_r), np.concatenate(got_v)


def dart_signatures(element: np.ndarray, doc: np.ndarray, n_docs: int, k: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature[document, coordinate], whether the document has elements).

    Elements of weight 1 may repeat inside a document: they throw the same darts.
    """
    mass = np.bincount(doc, weights=weight, minlength=n_docs).astype(float)
    signature = np.zeros((n_docs, k), dtype=np.uint64)
    wanted = k * np.log(k) + 2 * k if k > 1 else 4.0
    limit = np.where(mass > 0, wanted / np.maximum(mass, 1e-300), 0.0)
    open_docs = mass > 0
    while open_docs.any():
        mine = open_docs[doc]
        d, rank, dart = _throw(element[mine], doc[mine], None if weight is None else weight[mine], np.where(open_docs, limit, 0))
        slot = d * k + (shared.mix64(dart + _M) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank))[::-1]
        flat = np.zeros(n_docs * k, dtype=np.uint64)
        full = np.zeros(n_docs * k, dtype=bool)
        flat[slot[order]] = dart[order]
        full[slot] = True
        done = open_docs & full.reshape(n_docs, k).all(axis=1)
        signature[done] = flat.reshape(n_docs, k)[done]
        open_docs &= ~done
        limit = np.where(open_docs, limit * 2, limit)
    return signature, mass > 0


def _sequence_key(h: np.ndarray, doc: np.ndarray, n_docs: int, salt: int) -> np.ndarray:
    """A 64-bit key of each document's word sequence."""
    n = np.bincount(doc, minlength=n_docs)
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    term = shared.mix64(shared.mix64(place.astype(np.uint64) + np.uint64(salt)) ^ h)
    total = np.concatenate(([np.uint64(0)], np.cumsum(term)))
    end = np.cumsum(n)
    return shared.mix64(total[end] - total[end - n])


_PASS = "id long, k1 long, k2 long, n_words long, bands array<long>, sig binary"


@shared.tidy
def _describe(batches):
    k = BANDS * ROWS
    for part in shared.slices(batches, SLICE, "text"):
        texts = part["text"].tolist()
        s, sd, h, hd = shingles(texts)
        sig, some = dart_signatures(s, sd, len(texts), k)
        band = np.zeros((len(texts), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            band = shared.mix64(band * _M + sig[:, r::ROWS][:, :BANDS])
        band = shared.signed(band ^ shared.mix64(np.arange(BANDS, dtype=np.uint64)))
        low = (sig & np.uint64(255)).astype(np.uint8)
        yield pd.DataFrame(
            {
                "id": part["id"],
                "k1": shared.signed(_sequence_key(h, hd, len(texts), 1)),
                "k2": shared.signed(_sequence_key(h, hd, len(texts), 1 << 33)),
                "n_words": np.bincount(hd, minlength=len(texts)),
                "bands": [b if ok else None for b, ok in zip(band, some)],
                "sig": [x.tobytes() if ok else None for x, ok in zip(low, some)],
            }
        )


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by the shares of equal low bytes, corrected for chance."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


@shared.tidy
def _plausible(batches):
    for batch in batches:
        if len(batch):
            a = np.frombuffer(b"".join(batch["sa"]), np.uint8).reshape(len(batch), -1)
            b = np.frombuffer(b"".join(batch["sb"]), np.uint8).reshape(len(batch), -1)
            yield batch.loc[_agree(a, b) >= ESTIMATE, ["a", "b"]]


@shared.tidy
def _shingle_sets(batches):
    """Sorted shingle hashes of each text, all 64 bits: the sets that the exact check compares."""
    for part in shared.slices(batches, SLICE, "text"):
        s, d, _, _ = shingles(part["text"].tolist())
        order = np.argsort(d, kind="stable")
        s, at = s[order], np.concatenate(([0], np.cumsum(np.bincount(d, minlength=len(part)))))
        sets = [np.unique(s[at[i] : at[i + 1]]).tobytes() for i in range(len(part))]
        yield pd.DataFrame({"id": part["id"], "set": sets})


def _candidates(own: pd.DataFrame, other: pd.DataFrame):
    """For each row of one side, the places of the other side's rows that the signatures leave possible.

    A pair is looked at in the first band it shares, and only if its components differ.
    """
    b = np.frombuffer(b"".join(other["sig"]), np.uint8).reshape(len(other), -1)
    bands, comps = np.vstack(other["bands"].to_list()), other["component"].to_numpy()
    here = own["band"].iloc[0]
    for c, s, mine in zip(own["component"], own["sig"], own["bands"]):
        mine = np.asarray(mine)
        first = mine[(bands == mine).argmax(axis=1)] == here
        yield np.flatnonzero(first & (comps != c) & (_agree(np.frombuffer(s, np.uint8)[None, :], b) >= ESTIMATE))


def _live_rows(block: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block with a possible partner in it; only those need their shingle sets."""
    own, other = _sides(block)
    named: set[int] = set()
    if len(own) and len(other):
        ids = other["id"].to_numpy()
        for i, at in zip(own["id"], _candidates(own, other)):
            if len(at):
                named.add(i)
                named.update(ids[at].tolist())
    return pd.DataFrame({"band": np.full(len(named), block["band"].iloc[0]), "id": np.array(sorted(named), dtype=np.int64)})


def _block_pairs(block: pd.DataFrame) -> pd.DataFrame:
    """Similar pairs between the two sides of a block that join different components.

    The sets are those that ``_exact`` compares, so only pairs that hold join
    components. A pair is not looked at once others of the block have joined
    its components.
    """
    own, other = _sides(block)
    out = []
    if len(own) and len(other):
        ids, comps = other["id"].to_numpy(), other["component"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in other["set"]]
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for i, c, x, at in zip(own["id"], own["component"], own["set"], _candidates(own, other)):
            x = np.frombuffer(x, np.uint64)
            for j in at:
                p, q = find(int(c)), find(int(comps[j]))
                if p == q:
                    continue
                both = len(np.intersect1d(x, sets[j], assume_unique=True))
                if both >= SIMILARITY * (len(x) + len(sets[j]) - both):
                    parent[max(p, q)] = min(p, q)
                    out.append((min(i, ids[j]), max(i, ids[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64).drop_duplicates()


def _blocks(rows: DataFrame, values: DataFrame):
    """Rows of a bucket dealt to blocks of bounded size, own rows against all rows, with the values of their ids.

    A bucket that fits one block goes there whole, each row once. The values are
    joined before rows are repeated for several blocks, so the join makes one row
    per member of a bucket, whatever the bucket's size.
    """
    shape = rows.groupBy("band").agg(F.count_if("own").alias("n_own"), F.count("*").alias("n")).where("n_own > 0")
    one = F.col("n") <= OTHER_BLOCK
    shape = shape.select("band", one.alias("one"), F.ceil(F.col("n_own") / OWN_BLOCK).cast("int").alias("ni"), F.ceil(F.col("n") / OTHER_BLOCK).cast("int").alias("nj"))
    dealt = rows.join(shape, "band").join(values, "id")
    place = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    spot = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    own = F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda j: spot(_OWN, place("ni", 1), j))
    other = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: spot(_OTHER, i, place("nj", 2)))
    whole = F.when(F.col("own"), F.array(spot(_OWN | _OTHER, F.lit(0), F.lit(0)))).otherwise(F.array(spot(_OTHER, F.lit(0), F.lit(0))))
    spots = F.when(F.col("one"), whole).when(F.col("own"), F.concat(own, other)).otherwise(other)
    return dealt.withColumn("spot", F.explode(spots)).drop("own", "one", "ni", "nj").select("*", "spot.*").drop("spot").groupBy("band", "i", "j")


def _sides(block: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return block[(block["side"] & _OWN) > 0], block[(block["side"] & _OTHER) > 0]


@shared.tidy
def _exact(batches):
    for part in shared.slices(batches, SLICE, "ta", "tb"):
        n = len(part)
        s, d, _, _ = shingles(part["ta"].tolist() + part["tb"].tolist())
        order = np.argsort(d, kind="stable")
        s, at = s[order], np.concatenate(([0], np.cumsum(np.bincount(d, minlength=2 * n))))
        keep = np.zeros(n, dtype=bool)
        for i in range(n):
            x = np.unique(s[at[i] : at[i + 1]])
            y = np.unique(s[at[n + i] : at[n + i + 1]])
            both = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - both
            keep[i] = both >= SIMILARITY * union and union > 0
        yield part.loc[keep, ["a", "b"]]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts linked by Jaccard similarity >= 0.8 of their five-word shingle sets.

    Returns one row per input row: doc_id, text_id (smallest id of the rows
    with the same words in the same order), group_id (smallest id reachable by
    links), kept (doc_id = group_id). Words are separated by ASCII white space.
    Texts that are null or without words, and rows of null id, are alone.
    Rows that repeat an id are one document. An empty table gives no rows;
    extra columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = shared.materialize(slim.mapInPandas(_describe, _PASS))
    usable = F.col("id").isNotNull() & (F.col("n_words") > 0)
    key = ["k1", "k2", "n_words"]
    classes = shared.materialize(
        seen.where(usable).groupBy(*key).agg(F.min("id").alias("text_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    )
    reps = classes.select(F.col("text_id").alias("id"), "bands", "sig")
    rows = reps.select("id", F.explode("bands").alias("band"))
    first = shared.materialize(rows.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"))
    bucket = shared.materialize(_maybe(rows, first, "band").join(first, "band").select("band", "id", "head"))
    # Each text meets the head that it shares most bands with; the blocks below do the rest.
    shares = bucket.where("id <> head").groupBy("id", "head").agg(F.count("*").alias("n"))
    star = shares.groupBy(F.col("id").alias("b")).agg(F.min(F.struct(-F.col("n"), F.col("head").alias("head"))).alias("m")).select(F.col("m.head").alias("a"), "b")
    star = shared.materialize(star)
    asked = _maybe(reps.select("id", "sig"), star.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    sig_a = asked.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    sig_b = asked.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    likely = shared.materialize(star.join(sig_b, "b").join(sig_a, "a").mapInPandas(_plausible, "a long, b long"))
    links = _verified(likely, slim)
    groups = components(links)

    # Members of a bucket that are in another component than its head meet all others.
    tagged = (
        bucket.join(groups, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .join(groups.select(F.col("id").alias("head"), F.col("component").alias("of_head")), "head", "left")
        .join(star.select(F.col("b").alias("id"), F.col("a").alias("met")), "id", "left")
        .withColumn("own", F.col("component") != F.coalesce("of_head", "head"))
    )
    tagged = tagged.withColumn("open", F.col("own") & ~F.coalesce(F.col("met") == F.col("head"), F.lit(False)))
    tagged = shared.materialize(tagged.select("band", "id", "component", "own", "open"))
    shape = tagged.groupBy("band").agg(F.count_if("own").alias("rest"), F.count_if("open").alias("open"), F.count("*").alias("n"))
    shape = shape.where("rest > 0 and (n > 2 or open > 0)").select("band")
    met = shared.materialize(tagged.drop("open").join(shape, "band"))
    # Signatures first: few rows have a possible partner left, and only their texts are fetched.
    marks = _maybe(reps, met.select("id").distinct(), "id")
    live = shared.materialize(_blocks(met, marks).applyInPandas(_live_rows, "band long, id long").distinct())
    met = shared.materialize(met.join(live, ["band", "id"]))
    sets = shared.materialize(_texts(met.select("id"), slim).mapInPandas(_shingle_sets, "id long, set binary").distinct())
    marks = _maybe(reps, met.select("id").distinct(), "id").join(sets, "id")
    more = _blocks(met, marks).applyInPandas(_block_pairs, "a long, b long").distinct()
    more = shared.materialize(more)
    if not more.isEmpty():
        links = links.unionByName(more)
        groups = components(links)

    final = classes.select(*key, "text_id").join(groups.withColumnRenamed("id", "text_id"), "text_id", "left")
    final = shared.materialize(final.select(*key, "text_id", F.coalesce("component", "text_id").alias("group_id")))
    grouped = seen.where(usable).select("id", *key).join(final, key).select("id", "text_id", "group_id")
    alone = seen.where(~usable).select("id", F.col("id").alias("text_id"), F.col("id").alias("group_id"))
    return grouped.unionByName(alone).select(
        F.col("id").alias("doc_id"), "text_id", "group_id", F.coalesce(F.col("id") == F.col("group_id"), F.lit(True)).alias("kept")
    )


def _maybe(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be one of ``named``'s: a bitmap of bounded size keeps most others out of the shuffles.

    The bitmap grows with the keys up to FILTER_BITS / 64 rows; a fuller one lets more pass, and the join that follows is exact.
    """
    count, bits = named.count(), 1 << 16
    while bits < min(16 * count, FILTER_BITS):
        bits *= 2
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    word, bit = F.shiftright(slot, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    bitmap = named.select(key).groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    passed = rows.withColumn("__word", word).join(F.broadcast(bitmap), "__word").where(F.col("__bits").bitwiseAND(bit) != 0)
    return passed.drop("__word", "__bits")


def _texts(named: DataFrame, slim: DataFrame) -> DataFrame:
    """(id, text) of the rows whose id is named."""
    named = shared.materialize(named.distinct())
    return _maybe(slim, named, "id").select("id", "text").join(named, "id")


def _verified(pairs: DataFrame, slim: DataFrame) -> DataFrame:
    """The pairs whose whole texts reach the similarity."""
    texts = shared.materialize(_texts(pairs.select(F.explode(F.array("a", "b")).alias("id")), slim))
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a"
    )
    return shared.materialize(both.mapInPandas(_exact, "a long, b long").distinct())
