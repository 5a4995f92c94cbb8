"""Language-model scoring with a probabilistic suffix tree over words.

The root predicts the next token, a word or the end of the text, from smoothed
counts of all training tokens. Deeper states are contexts of one to DEPTH words
before it, of any words. A context is retained if its next-token distribution diverges from
that of its longest retained suffix: leaving out one occurrence at a time, it
must predict its own occurrences better. Retained distributions are smoothed
towards that of the suffix, and each token is scored in the longest retained
state.

The suffixes of a context end in the same word, so the tree falls into
independent chunks by the last word of its contexts. Texts become slices of word
numbers; a slice sends each chunk its places once, as packed arrays: distinct
(context, next token) with how often and in which texts they occur. A chunk
counts, grows its states and scores training and other places by them in numpy, and
answers with a sum per text, so that no row per place or per state is shuffled
or joined.

A word with more than half of ``chunk`` places has chunks of its own, by the word before
it; the counts of its next tokens, which these share, are summed beforehand and
sent to all of them. Numbers of words are dealt in buckets by falling training
count, so the count of a number is found in a table of the buckets' steps, whose
length grows with the square root of the tokens.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

DEPTH = 3
#: Buckets of the words' hashes, which are numbered each by itself.
BUCKETS = 256
#: Places of a chunk of the tree, about; words with more than half as many have chunks of their own.
CHUNK = 1 << 20
#: Characters of a slice of texts, or one longer text.
SLICE = 4 << 20
#: Packed counts that are merged at once.
MERGED = 1 << 20
_K = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0x7FFF_FFFF_FFFF_FFF1)
_32 = np.uint64(32)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers from 0 on, each in its narrowest type, compressed."""
    out = []
    for a in arrays:
        raw = a.astype(np.min_scalar_type(int(a.max(initial=0))))
        data = pa.compress(raw.tobytes(), codec="zstd", asbytes=True)
        out += [struct.pack("<BQQ", raw.itemsize, len(raw), len(data)), data]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        width, n, size = struct.unpack_from("<BQQ", blob, at)
        at += 17
        data = pa.decompress(blob[at : at + size], decompressed_size=width * n, codec="zstd", asbytes=True) if n else b""
        out.append(np.frombuffer(data, f"<u{width}"))
        at += size
    return out


def _joined(blobs) -> list[np.ndarray]:
    """The arrays of several packs, each joined."""
    return [np.concatenate(x) for x in zip(*map(_unpack, blobs))]


def _edges(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    n = len(sorted_by[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _tidy(run: Callable) -> Callable:
    """A function of groups that releases its memory after each."""

    def wrapped(*groups):
        try:
            return run(*groups)
        finally:
            shared.release()

    # Spark tells functions of a group and of its key by their arguments.
    return (lambda a, b: wrapped(a, b)) if run.__code__.co_argcount == 2 else (lambda a: wrapped(a))


_SLICED = "slice long, bucket int, ids array<string>, held binary, sizes binary, words binary, counts binary"


@shared.tidy
def _slice(batches):
    """Texts as places in the slice's dictionary, in the row of bucket -1, and the dictionary with its counts, a row per bucket."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for part in shared.slices(batches, SLICE, "text"):
        n, held = len(part), part["held_out"].to_numpy(dtype=bool)
        words, doc = shared.word_hashes(part["text"].tolist(), lower=True)
        sizes = np.bincount(doc, minlength=n) + 1
        h = np.full(len(words) + n, _END)
        h[np.arange(len(words)) + doc] = words
        u, code, total = np.unique(h, return_inverse=True, return_counts=True)
        train = np.bincount(code, weights=np.repeat(~held, sizes), minlength=len(u)).astype(np.int64)
        bucket = (u % np.uint64(BUCKETS)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(u), dtype=np.int64)
        place[order] = np.arange(len(u))
        first = np.append(_edges(bucket[order]), len(u))
        rows = [(number, -1, part["doc_id"].tolist(), held.tobytes(), _pack(sizes), _pack(place[code]), None)]
        for lo, hi in zip(first[:-1], first[1:]):
            of = order[lo:hi]
            rows.append((number, int(bucket[of[0]]), None, None, None, u[of].tobytes(), _pack(train[of], total[of])))
        yield pd.DataFrame(rows, columns=["slice", "bucket", "ids", "held", "sizes", "words", "counts"])
        number += 1


_NUMBERED = "slice long, bucket int, numbers binary, common binary, n long, v long, total long"


def _number(chunk: int):
    """Numbers of a bucket's words, from 1 on, for each slice; in the row of slice -1 the steps of their counts, words of many places and sums."""

    @_tidy
    def run(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iloc[0])
        h = np.frombuffer(b"".join(group["words"]), np.uint64)
        c, total = _joined(group["counts"])
        u, code = np.unique(h, return_inverse=True)
        c, total = (np.bincount(code, weights=x).astype(np.int64) for x in (c, total))
        order = np.lexsort((u, -total, -c))
        rank = np.empty(len(u), dtype=np.int64)
        rank[order] = np.arange(len(u))
        number = rank * BUCKETS + bucket + 1
        if int(number.max()) >> 32:
            raise ValueError("more distinct words than 32 bits number")
        step = _edges(c[order])
        common = np.flatnonzero(total > chunk // 2)
        rows = [(-1, bucket, _pack(step, c[order][step]), _pack(number[common], total[common]), int(c.sum()), int((c > 0).sum()), int(total.sum()))]
        at = np.append(0, np.cumsum([len(x) // 8 for x in group["words"]]))
        for s, lo, hi in zip(group["slice"], at[:-1], at[1:]):
            rows.append((s, bucket, _pack(number[code[lo:hi]]), None, 0, 0, 0))
        return pd.DataFrame(rows, columns=["slice", "bucket", "numbers", "common", "n", "v", "total"])

    return run


class Counts:
    """Training counts of numbered words."""

    def __init__(self, rows):
        found = sorted((r["bucket"], *_unpack(r["numbers"])) for r in rows)
        self.keys = np.concatenate([np.uint64(b << 40) + x.astype(np.uint64) for b, x, _ in found] or [np.zeros(0, np.uint64)])
        self.values = np.concatenate([x.astype(np.int64) for *_, x in found] or [np.zeros(0, np.int64)])

    def of(self, number: np.ndarray) -> np.ndarray:
        x = number.astype(np.uint64) - np.uint64(1)
        key = ((x % np.uint64(BUCKETS)) << np.uint64(40)) + x // np.uint64(BUCKETS)
        return self.values[np.searchsorted(self.keys, key, side="right") - 1]


_RESOLVED = "slice long, ids array<string>, held binary, sizes binary, known binary, base binary, numbers binary"


def _resolve(counts):
    """A slice's texts as word numbers, with their base terms."""

    @_tidy
    def run(texts: pd.DataFrame, numbered: pd.DataFrame) -> pd.DataFrame:
        (row,) = texts.itertuples()
        number = _joined(numbered.sort_values("bucket")["numbers"])[0]
        c = counts.value.of(number)
        (sizes,), (words,) = _unpack(row.sizes), _unpack(row.words)
        first = np.append(0, np.cumsum(sizes, dtype=np.int64))[:-1]
        known = np.add.reduceat((c > 0).astype(np.int64)[words], first)
        base = np.add.reduceat(np.log10(c + 0.5)[words], first)
        return pd.DataFrame(
            [(row.slice, row.ids, row.held, row.sizes, _pack(known), base.tobytes(), _pack(number[words]))],
            columns=["slice", "ids", "held", "sizes", "known", "base", "numbers"],
        )

    return run


def _places(row) -> tuple[np.ndarray, ...]:
    """(last word, the one before, the one before that, next token, text, in training) of every place with a context; no word is 0."""
    (sizes,), (number,) = _unpack(row.sizes), _unpack(row.numbers)
    number = number.astype(np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(doc[1:] == doc[:-1])

    def back(k: int) -> np.ndarray:
        i = at - k
        return np.where((i >= 0) & (doc[np.maximum(i, 0)] == doc[at]), number[np.maximum(i, 0)], np.uint64(0))

    train = ~np.frombuffer(row.held, bool)
    return number[at], back(1), back(2), number[at + 1], doc[at], train[doc[at]]


def _share(numbers: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are among the sorted numbers, and where."""
    if not len(numbers):
        return np.zeros(len(word), dtype=bool), np.zeros(len(word), dtype=np.int64)
    spot = np.minimum(np.searchsorted(numbers, word), len(numbers) - 1)
    return numbers[spot] == word, spot


_PLACED = "chunk long, slice long, states binary, docs binary"


def _deal(common, chunks: int):
    """A row per slice and chunk: distinct contexts with next tokens, their places in training and in all, and the texts of these in turn."""

    @shared.tidy
    def run(batches):
        numbers, firsts, shares = common.value
        for batch in batches:
            for row in batch.itertuples():
                w, w1, w2, nxt, doc, train = _places(row)
                chunk = (shared.mix64(w) % np.uint64(chunks)).astype(np.int64)
                hit, spot = _share(numbers, w)
                if hit.any():
                    spot = spot[hit]
                    chunk[hit] = firsts[spot] + (shared.mix64(w1[hit] ^ _K) % shares[spot].astype(np.uint64)).astype(np.int64)
                near, far = (w << _32) | w1, (w2 << _32) | nxt
                order = np.lexsort((far, near, chunk.astype(np.min_scalar_type(int(chunk.max(initial=0))))))
                chunk, near, far, doc, train = (x[order] for x in (chunk, near, far, doc, train))
                new = _edges(chunk, near, far)
                if not len(new):
                    continue
                times = np.diff(np.append(new, len(doc)))
                trained = np.add.reduceat(train.astype(np.int64), new)
                w, w1, w2, nxt = near[new] >> _32, near[new] & np.uint64(0xFFFFFFFF), far[new] >> _32, far[new] & np.uint64(0xFFFFFFFF)
                ends = np.append(_edges(chunk[new]), len(new))
                at = np.append(new, len(doc))
                rows = [
                    (int(chunk[at[lo]]), row.slice, _pack(*(x[lo:hi] for x in (w, w1, w2, nxt, trained, times))), _pack(doc[at[lo] : at[hi]]))
                    for lo, hi in zip(ends[:-1], ends[1:])
                ]
                yield pd.DataFrame(rows, columns=["chunk", "slice", "states", "docs"])

    return run


def _follow(common):
    """Next tokens of common words in a slice's training texts with their counts, a row per word."""

    @shared.tidy
    def run(batches):
        numbers = common.value[0]
        for batch in batches:
            for row in batch.itertuples():
                w, _, _, nxt, _, train = _places(row)
                hit = _share(numbers, w)[0] & train
                pair, n = np.unique((w[hit] << _32) | nxt[hit], return_counts=True)
                w, nxt = pair >> _32, pair & np.uint64(0xFFFFFFFF)
                ends = np.append(_edges(w), len(w)) if len(w) else [0]
                rows = [(int(w[lo]), _pack(nxt[lo:hi], n[lo:hi])) for lo, hi in zip(ends[:-1], ends[1:])]
                yield pd.DataFrame(rows, columns=["word", "follow"])

    return run


def _summed(nxt: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, code = np.unique(nxt, return_inverse=True)
    return u, np.bincount(code, weights=n, minlength=len(u)).astype(np.int64)


def _shared_counts(common):
    """All next tokens of a common word with their counts, for each of its chunks."""

    @_tidy
    def run(group: pd.DataFrame) -> pd.DataFrame:
        numbers, firsts, shares = common.value
        spot = np.searchsorted(numbers, np.uint64(group["word"].iloc[0]))
        have, held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        for blob in group["follow"]:
            have.append(tuple(_unpack(blob)))
            held += len(have[-1][0])
            if held > MERGED + len(have[0][0]):
                have, held = [_summed(*map(np.concatenate, zip(*have)))], 0
        follow = _pack(*_summed(*map(np.concatenate, zip(*have))))
        each = firsts[spot] + np.arange(shares[spot])
        return pd.DataFrame({"chunk": each, "slice": -1, "states": follow, "docs": None})

    return run


def _step(context: np.ndarray, nxt: np.ndarray, trained: np.ndarray, p: np.ndarray, known=None) -> tuple[np.ndarray, np.ndarray]:
    """One level of the tree: (probability of each state's next token, whether longer contexts can be retained).

    ``context`` numbers the contexts, ``p`` is the probability under the longest
    retained suffix. ``known``: (next tokens, counts) of the only context.
    """
    order = np.argsort((context << _32) | nxt, kind="stable")
    c, x = context[order], nxt[order]
    del context, nxt
    first = _edges(c, x)
    pair = np.empty(len(order), dtype=np.int64)
    pair[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    c, x, q = c[first].astype(np.int64), x[first], p[order[first]]
    if known is None:
        n = np.add.reduceat(trained[order], first)
        starts = _edges(c)
        c = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(c))))
        total, t, most = np.add.reduceat(n, starts), np.add.reduceat((n > 0).astype(np.int64), starts), np.maximum.reduceat(n, starts)
        gain = np.bincount(c, weights=_gain(n, t[c], total[c], q))
    else:
        seen, counts, root = known
        n, c = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        hit, spot = _share(seen, x)
        n[hit] = counts[spot[hit]]
        total, t, most = np.array([counts.sum()]), np.array([len(seen)]), counts.max(initial=0, keepdims=True)
        gain = np.array([_gain(counts, t, total, root).sum()])
    keep = (most > 1) & (gain > 1e-9)
    total, t = total[c], t[c]
    q = np.where(keep[c], (n + t * q) / np.maximum(total + t, 1), q)
    return q[pair], (most > 1)[c][pair]


def _gain(n: np.ndarray, t: np.ndarray, total: np.ndarray, p: np.ndarray) -> np.ndarray:
    """By how much a context predicts its occurrences better than its suffix, leaving out one at a time."""
    left_out = (n - 1 + t * p) / np.maximum(total - 1 + t, 1)
    return n * np.log(np.where(n > 0, left_out / p, 1))


def _grow(counts, n: int, v: int):
    """Grows a chunk of the tree and sums what its states add to the base terms of each text, log10."""

    @_tidy
    def run(group: pd.DataFrame) -> pd.DataFrame:
        chunk = int(group["chunk"].iloc[0])
        root = lambda x: (counts.value.of(x) + 0.5) / (n + 0.5 * (v + 1))
        known = None
        for blob in group.loc[group["slice"] < 0, "states"]:
            seen, many = (x.astype(k) for x, k in zip(_unpack(blob), (np.uint64, np.int64)))
            known = seen, many, root(seen)
        rows = group[group["slice"] >= 0].sort_values("slice")
        if not len(rows):
            return pd.DataFrame(columns=["chunk", "slice", "docs", "sums"])
        packs = [_unpack(x) for x in rows["states"]]
        w, w1, w2, nxt, trained = (np.concatenate([x[i] for x in packs]) for i in range(5))
        times = [x[5] for x in packs]
        del packs
        order = np.lexsort(((w2.astype(np.uint64) << _32) | nxt, (w.astype(np.uint64) << _32) | w1)).astype(np.int32 if len(w) >> 31 == 0 else np.int64)
        w, w1, w2, nxt = (x[order] for x in (w, w1, w2, nxt))
        trained = trained[order].astype(np.int64)
        base = root(nxt)
        p = base.copy()
        live = np.arange(len(w))
        for k, words in enumerate(((w,), (w, w1), (w, w1, w2))):
            live = live[words[-1][live] > 0]
            if not len(live):
                break
            first = _edges(*(x[live] for x in words))
            context = np.repeat(np.arange(len(first), dtype=np.uint64), np.diff(np.append(first, len(live))))
            p[live], more = _step(context, nxt[live].astype(np.uint64), trained[live], p[live], known if k == 0 else None)
            live = live[more]
        term = np.empty(len(p))
        term[order] = np.log10(p) - np.log10(base)
        out, at = [], 0
        for s, times_of, docs in zip(rows["slice"], times, rows["docs"]):
            (doc,) = _unpack(docs)
            sums = np.bincount(doc, weights=np.repeat(term[at : at + len(times_of)], times_of))
            there = np.flatnonzero(np.bincount(doc))
            at += len(times_of)
            out.append((chunk, s, _pack(there), sums[there].tobytes()))
        return pd.DataFrame(out, columns=["chunk", "slice", "docs", "sums"])

    return run


def _finish(n: int, v: int):
    """A row per text of a slice."""

    @_tidy
    def run(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        (row,) = texts.itertuples()
        (sizes,), (known,) = _unpack(row.sizes), _unpack(row.known)
        base = np.frombuffer(row.base, float) - sizes.astype(float) * np.log10(n + 0.5 * (v + 1))
        term = np.zeros(len(sizes))
        for r in found.sort_values("chunk").itertuples():
            term[_unpack(r.docs)[0]] += np.frombuffer(r.sums, float)
        return pd.DataFrame(
            {
                "doc_id": pd.Series(list(row.ids), dtype=object),
                "held_out": np.frombuffer(row.held, bool),
                "n_tokens": sizes.astype(np.int64),
                "n_known": known.astype(np.int64),
                "base_score": base,
                "score": base + term,
            }
        )

    return run


def score_texts(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """Scores of all whole texts by a model learned from rows where ``held_out`` is false.

    Returns one row per input row: doc_id, held_out, n_tokens (words and one
    end), n_known, train_tokens, base_score (smoothed unigram, log10), score
    (suffix tree, log10). Only A-Z are lowered. A null text is an empty one:
    its only token is the end. Without training rows every count is 0. Repeated
    rows are counted and scored each; an empty table gives no rows; extra
    columns are not read. ``chunk`` bounds memory, not what is counted.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    # As text, ids pass through pandas unchanged, null ones too.
    slim = docs.select(F.col(id_col).cast("string").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    folder = shared.scratch_dir(spark)
    sliced = shared.materialize(slim.mapInPandas(_slice, _SLICED), folder)
    words = sliced.where("bucket >= 0").select("slice", "bucket", "words", "counts")
    numbered = shared.materialize(words.groupBy("bucket").applyInPandas(_number(chunk), _NUMBERED), folder)
    stats = numbered.where("slice < 0").collect()
    n, v, every = (sum(r[x] for r in stats) for x in ("n", "v", "total"))
    counts = spark.sparkContext.broadcast(Counts(stats))
    texts = sliced.where("bucket < 0").select("slice", "ids", "held", "sizes", "words")
    numbers = numbered.where("slice >= 0").select("slice", "bucket", "numbers")
    coded = shared.materialize(texts.groupBy("slice").cogroup(numbers.groupBy("slice")).applyInPandas(_resolve(counts), _RESOLVED))
    shared.discard(spark, folder)

    chunks = max(1, -(-every // chunk))
    number, total = (np.concatenate([x.astype(np.int64) for x in a] or [np.zeros(0, np.int64)]) for a in zip(*(_unpack(r["common"]) for r in stats))) if stats else (np.zeros(0, np.int64),) * 2
    order = np.argsort(number)
    shares = -(-total[order] // max(1, chunk // 2))
    common = spark.sparkContext.broadcast((number[order].astype(np.uint64), chunks + np.cumsum(shares) - shares, shares))
    bare = coded.select("slice", "held", "sizes", "numbers")
    placed = bare.mapInPandas(_deal(common, chunks), _PLACED)
    if len(number):
        follow = bare.mapInPandas(_follow(common), "word long, follow binary")
        placed = placed.unionByName(follow.groupBy("word").applyInPandas(_shared_counts(common), _PLACED))
    found = placed.groupBy("chunk").applyInPandas(_grow(counts, n, v), "chunk long, slice long, docs binary, sums binary")
    found = shared.materialize(found)

    of_texts = coded.select("slice", "ids", "held", "sizes", "known", "base")
    scored = of_texts.groupBy("slice").cogroup(found.groupBy("slice")).applyInPandas(
        _finish(n, v), "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "held_out", "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )
