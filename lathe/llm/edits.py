"""Edit-aware token counts.

A text is cut into pre-tokens by the tokenizer's pattern; a segment tree over
them holds token counts and lengths, sums in the inner nodes. The trees are a
table, a row per document: ``build_trees`` encodes each text once, and
``apply_edits`` reads stored trees, changes them and returns them, so an edit
costs what it touches. An edit replaces a span of characters: the touched
pre-tokens and a few around them are cut again until the new cut meets an old
one, only the changed ones are encoded, and only the sums above them are updated.

The cut at a place depends on the text from there on and on nothing before it,
but a pre-token may need what follows: so the new cut starts one pre-token
before the edit, and ends where it meets an old cut beyond the edited span.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 100_000
#: Characters of the texts that are held as trees at once, or one longer text.
SLICE = 1 << 20


class _ZIP:
    """Packed arrays of small numbers; the packer is made in the worker that needs it."""

    @staticmethod
    def compress(data: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=1).compress(data)

    @staticmethod
    def decompress(data: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data)


class Counter:
    """Tokens per pre-token, remembered within a bound."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.memo: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(piece) <= 64:
                self.memo[piece] = n
        return n


@dataclass
class SegmentTree:
    """Pre-tokens of a text in a balanced tree of sums: characters and tokens below each node.

    Leaves are chunks of pre-tokens, so that a changed number of pre-tokens
    changes one leaf and not the shape of the tree; a leaf that grew beyond
    twice its size is cut, and the sums are laid out anew.
    """

    counter: Counter
    text: str
    leaf: int = 64
    stored: tuple[bytes, bytes] | None = None
    pieces: list[list[str]] = field(default_factory=list)
    counts: list[list[int]] = field(default_factory=list)
    chars: list[np.ndarray] = field(default_factory=list)
    tokens: list[np.ndarray] = field(default_factory=list)
    encoded: int = 0

    def __post_init__(self) -> None:
        if self.stored is None:
            cut = self.counter.cut.findall(self.text)
            count = self.counter.count
            sizes = [count(p) for p in cut]
        else:
            lengths, sizes = (np.frombuffer(_ZIP.decompress(x), np.uint32) for x in self.stored)
            ends = np.cumsum(lengths, dtype=np.int64).tolist()
            cut = [self.text[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            sizes = sizes.tolist()
        self._fill(cut, sizes)

    def _fill(self, cut: list[str], sizes: list[int]) -> None:
        self.pieces, self.counts = [], []
        for lo in range(0, max(len(cut), 1), self.leaf):
            self.pieces.append(cut[lo : lo + self.leaf])
            self.counts.append(sizes[lo : lo + self.leaf])
        self._sums()

    def _sums(self) -> None:
        chars = np.array([sum(map(len, p)) for p in self.pieces], dtype=np.int64)
        tokens = np.array([sum(c) for c in self.counts], dtype=np.int64)
        self.chars, self.tokens = [chars], [tokens]
        while len(chars) > 1:
            pairs = np.arange(0, len(chars), 2)
            chars, tokens = np.add.reduceat(chars, pairs), np.add.reduceat(tokens, pairs)
            self.chars.append(chars)
            self.tokens.append(tokens)

    def _split(self, leaf: int) -> None:
        """Cut a leaf that grew too large; its parts take its place."""
        n = len(self.pieces[leaf])
        if n > 2 * self.leaf:
            for held in (self.pieces, self.counts):
                held[leaf : leaf + 1] = [held[leaf][lo : lo + self.leaf] for lo in range(0, n, self.leaf)]
            self._sums()

    def store(self) -> tuple[bytes, bytes]:
        """Lengths and token counts of the pre-tokens, packed."""
        lengths = np.fromiter((len(p) for leaf in self.pieces for p in leaf), np.uint32)
        sizes = np.fromiter((c for leaf in self.counts for c in leaf), np.uint32)
        return _ZIP.compress(lengths.tobytes()), _ZIP.compress(sizes.tobytes())

    @property
    def total(self) -> int:
        return int(self.tokens[-1][0])

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character, or the last one."""
        node, start = 0, 0
        for level in range(len(self.chars) - 1, 0, -1):
            left = 2 * node
            below = self.chars[level - 1]
            if at >= start + below[left] and left + 1 < len(below):
                start += int(below[left])
                node = left + 1
            else:
                node = left
        return node, start

    def _update(self, leaf: int) -> None:
        chars, tokens = sum(map(len, self.pieces[leaf])), sum(self.counts[leaf])
        d_chars, d_tokens = chars - int(self.chars[0][leaf]), tokens - int(self.tokens[0][leaf])
        for level in range(len(self.chars)):
            self.chars[level][leaf >> level] += d_chars
            self.tokens[level][leaf >> level] += d_tokens

    def _step(self, leaf: int, k: int) -> tuple[int, int] | None:
        """The next pre-token's place, over empty leaves."""
        k += 1
        while k >= len(self.pieces[leaf]):
            leaf, k = leaf + 1, 0
            if leaf == len(self.pieces):
                return None
        return leaf, k

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters start to stop by ``new``; both are clipped to the text."""
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        old = self.text
        self.text = old[:start] + new + old[stop:]
        shift = len(new) - (stop - start)
        # One pre-token before the edit may change with what follows it.
        leaf, at = self.find(max(start - 1, 0))
        k = 0
        while k + 1 < len(self.pieces[leaf]) and at + len(self.pieces[leaf][k]) < start:
            at += len(self.pieces[leaf][k])
            k += 1
        first_leaf, first_k, begin = leaf, k, at
        if begin > 0 and first_k > 0:
            first_k -= 1
            begin -= len(self.pieces[first_leaf][first_k])
        elif begin > 0 and first_leaf > 0:
            before = first_leaf - 1
            while before > 0 and not self.pieces[before]:
                before -= 1
            if self.pieces[before]:
                first_leaf, first_k = before, len(self.pieces[before]) - 1
                begin -= len(self.pieces[before][first_k])
        # Cut anew until a cut beyond the edit falls on an old one.
        place: tuple[int, int] | None = (first_leaf, first_k)
        if not self.pieces[first_leaf]:
            place = self._step(first_leaf, -1)
        old_at, fresh, cursor = begin, [], begin
        limit = start + len(new)
        met = None
        for m in self.counter.cut.finditer(self.text, begin):
            fresh.append(m[0])
            cursor = m.end()
            while place is not None and (old_at < stop or old_at + shift < cursor):
                old_at += len(self.pieces[place[0]][place[1]])
                place = self._step(*place)
            if cursor > limit and old_at >= stop and old_at + shift == cursor:
                met = place
                break
        else:
            place = None
            met = None
        count = self.counter.count
        sizes = [count(p) for p in fresh]
        self.encoded += len(fresh)
        end_leaf, end_k = met if met is not None else (len(self.pieces) - 1, len(self.pieces[-1]))
        if first_leaf == end_leaf:
            self.pieces[first_leaf][first_k:end_k] = fresh
            self.counts[first_leaf][first_k:end_k] = sizes
            self._update(first_leaf)
            self._split(first_leaf)
            return
        self.pieces[first_leaf][first_k:] = fresh
        self.counts[first_leaf][first_k:] = sizes
        self._update(first_leaf)
        for between in range(first_leaf + 1, end_leaf):
            self.pieces[between], self.counts[between] = [], []
            self._update(between)
        del self.pieces[end_leaf][:end_k]
        del self.counts[end_leaf][:end_k]
        self._update(end_leaf)
        self._split(first_leaf)


_counters: dict[int, Counter] = {}


def _counter(data: bytes) -> Counter:
    key = hash(data)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(data)
    return _counters[key]


_TREE = "text string, lengths binary, counts binary, n_tokens long, n_pretokens long"


def _vocabulary(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """doc_id, text, lengths and counts of its pre-tokens (the leaves of its tree), n_tokens, n_pretokens.

    A null text is an empty one. Each row has a tree of its own, so repeated
    rows, empty tables and extra columns need no rule.
    """
    sent = _vocabulary(docs, vocabulary_path)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @shared.tidy
    def run(batches):
        counter = _counter(sent.value)
        for part in shared.slices(batches, SLICE, "text"):
            rows = []
            for text in part["text"]:
                tree = SegmentTree(counter, text)
                rows.append((text, *tree.store(), tree.total, sum(map(len, tree.pieces))))
            frame = pd.DataFrame(rows, columns=["text", "lengths", "counts", "n_tokens", "n_pretokens"])
            frame.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield frame

    return slim.mapInPandas(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {_TREE}")


def apply_edits(trees: DataFrame, edits: Column, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """The trees after their edits, with n_tokens_before, n_pretokens_before and n_recut (pre-tokens cut and encoded again).

    ``trees`` has the columns of ``build_trees`` or of this function, ``edits``
    is array<struct<start:int, stop:int, new:string>> over a row: character
    spans of the text as the edits before have left it. Null edits, and null
    fields in one, change nothing; spans outside the text are clipped. Nothing
    but what an edit touches is encoded.
    """
    sent = _vocabulary(trees, vocabulary_path)
    columns = ["doc_id", "text", "lengths", "counts", "n_tokens", "n_pretokens"]
    slim = trees.select(*columns, edits.alias("edits"))

    @shared.tidy
    def run(batches):
        counter = _counter(sent.value)
        for part in shared.slices(batches, SLICE, "text"):
            rows = []
            for text, lengths, counts, changes in zip(part["text"], part["lengths"], part["counts"], part["edits"]):
                tree = SegmentTree(counter, text, stored=(lengths, counts))
                before, pretokens = tree.total, sum(map(len, tree.pieces))
                for e in changes if changes is not None else ():
                    if e is not None and e["start"] is not None and e["stop"] is not None and e["new"] is not None:
                        tree.edit(int(e["start"]), int(e["stop"]), e["new"])
                rows.append((tree.text, *tree.store(), tree.total, sum(map(len, tree.pieces)), before, pretokens, tree.encoded))
            frame = pd.DataFrame(rows, columns=[*columns[1:], "n_tokens_before", "n_pretokens_before", "n_recut"])
            frame.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield frame

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInPandas(run, f"doc_id {kind}, {_TREE}, n_tokens_before long, n_pretokens_before long, n_recut long")


def count_edits(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """Token counts of each whole text before and after its edits, by its stored tree.

    Returns doc_id, n_tokens, n_tokens_edited, n_pretokens, n_recut,
    n_chars_edited. The trees are written to the shared folder first and read
    back for the edits, which may read doc_id and text. Nulls, empty texts, repeated rows and clipping: as in
    ``build_trees`` and ``apply_edits``; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    trees = shared.materialize(build_trees(slim, vocabulary_path=vocabulary_path))
    done = apply_edits(trees.withColumn("edits", edits), F.col("edits"), vocabulary_path)
    first = F.col("n_tokens_before").alias("n_tokens")
    return done.select("doc_id", first, F.col("n_tokens").alias("n_tokens_edited"), F.col("n_pretokens_before").alias("n_pretokens"), "n_recut", F.length("text").cast("long").alias("n_chars_edited"))


def standing_edits(text_col: str = "text") -> Column:
    """Three edits of every text, from its length: a header put before it, a span in the middle masked, its last character cut off."""
    n = F.length(F.coalesce(F.col(text_col), F.lit("")))
    header = "Reviewed copy.\n"
    middle = (n / 2).cast("int") + len(header)
    edit = lambda a, b, s: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(s).alias("new"))
    return F.array(
        edit(F.lit(0), F.lit(0), header),
        edit(middle, middle + 12, "[masked]"),
        edit(n + len(header) - 12 + 8 - 1, n + len(header), ""),
    )
