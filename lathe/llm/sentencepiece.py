"""SentencePiece encoding and decoding: Aho-Corasick automaton and Viterbi.

The automaton holds all pieces. One pass over a text follows it character by
character; at each place the output links give every piece that ends there,
and each of them relaxes the best score of that place. Where no piece but a
single unknown character ends, the unknown score is used, and the character is
written as byte pieces if the model has them.

No piece of a usual model crosses from text into a following white space mark,
so the best path of a text is the concatenation of the best paths of its words
(each with the marks before it). That lets a worker keep the paths of words in
a bounded memo. A model with crossing pieces is run over whole texts instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose paths a worker remembers at most, twice.
MEMO = 100_000
#: Characters of the texts that are encoded between two outputs, or one longer text.
SLICE = 1 << 20
#: The unknown score lies this far below the lowest piece score.
UNKNOWN_GAP = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces, scores and flags of a model file, with encoder and decoder."""

    def __init__(self, data: bytes):
        import ahocorasick

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.dummy_prefix, self.squeeze, self.escape = True, True, True
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.types.append(kind)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2 and v:
                        raise ValueError("the model maps characters before it encodes; such models are not supported")
                    if n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        normal = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        self.unknown = self.types.index(UNKNOWN)
        self.unknown_score = min((self.scores[i] for i in normal), default=0.0) - UNKNOWN_GAP
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, t in enumerate(self.types) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            if self.pieces[i]:
                self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), self.scores[i], i))
        self.automaton.make_automaton()
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in normal)
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        # Words seen lately, and those of the time before: common words outlive a full memo.
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.text_of = [("" if t in (CONTROL, UNUSED) else p) for p, t in zip(self.pieces, self.types)]
        self.text_of[self.unknown] = " ⁇ "

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if self.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def viterbi(self, s: str) -> tuple[int, ...]:
        """Ids of the best path; of equal paths the one whose last piece is longest, at each place."""
        n = len(s)
        low = float("-inf")
        best, back, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        reached = 0
        single = [False] * (n + 1)
        # The last match, of no length, settles the places after all others.
        for end, (length, score, i) in chain(self.automaton.iter(s), ((n, (0, low, -1)),)):
            while reached < end:
                reached += 1
                if single[reached] or best[reached - 1] == low:
                    continue
                last = best[reached - 1] + self.unknown_score
                if last > best[reached]:
                    best[reached], back[reached], piece[reached] = last, reached - 1, self.unknown
            if not length:
                break
            at = end + 1
            score += best[at - length]
            if length == 1:
                single[at] = True
            if score > best[at]:
                best[at], back[at], piece[at] = score, at - length, i
        path: list[int] = []
        at = n
        while at:
            if piece[at] == self.unknown and self.bytes:
                path += [self.bytes[b] for b in reversed(s[back[at] : at].encode("utf-8", "surrogatepass"))]
            else:
                path.append(piece[at])
            at = back[at]
        return tuple(reversed(path))

    def encode(self, text: str) -> list[int]:
        s = self.normalize(text)
        if self.crossing or not self.escape:
            return list(self.viterbi(s))
        memo, ids = self.memo, []
        for word in self.split(s):
            path = memo.get(word)
            if path is None:
                path = self.older.get(word) or self.viterbi(word)
                if len(memo) >= MEMO:
                    self.older, self.memo = memo, {}
                    memo = self.memo
                if len(word) <= 64:
                    memo[word] = path
            ids += path
        return ids

    def decode(self, ids) -> str:
        """The text of the ids: byte pieces are joined before decoding, marks become spaces."""
        byte_of, text_of = self.byte_of, self.text_of
        out: list[str] = []
        held = bytearray()
        if byte_of.keys().isdisjoint(ids):
            out, ids = [text_of[i] for i in ids], ()
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "surrogatepass"))
                held.clear()
            out.append(text_of[i])
        if held:
            out.append(held.decode("utf-8", "surrogatepass"))
        text = "".join(out)
        if self.escape:
            text = text.replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_models: dict[int, Model] = {}


def _model(data: bytes) -> Model:
    key = hash(data)
    if key not in _models:
        _models.clear()
        _models[key] = Model(data)
    return _models[key]


def read_model(path: str = MODEL) -> bytes:
    """The model file, read on the driver; its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, text_col: str = "text", into: str = "ids", model_path: str = MODEL, check: str | None = None) -> DataFrame:
    """Adds the ids of each whole text; null texts give a null array, empty ones an empty array.

    ``check`` names a further column that holds whether decoding the ids gives
    the text again (its normal form, where the model squeezes spaces; a mark
    character in the text reads as a space). The model is broadcast (a
    vocabulary file). Other columns pass unchanged.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    names = docs.columns
    if into in names or check in names:
        raise ValueError("the new columns must not clash with columns of the table")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{into}` array<int>"]
    if check:
        fields.append(f"`{check}` boolean")

    @shared.tidy
    def run(batches):
        model = _model(data.value)
        for part in shared.slices(batches, SLICE, text_col):
            texts = part[text_col].tolist()
            ids = [None if t is None else np.asarray(model.encode(t), dtype=np.int32) for t in texts]
            out = part.assign(**{into: ids})
            if check:
                out[check] = [None if t is None else _same(model, t, i.tolist()) for t, i in zip(texts, ids)]
            yield out

    return docs.mapInPandas(run, ", ".join(fields))


def _same(model: Model, text: str, ids: list[int]) -> bool:
    want = model.normalize(text)
    if model.escape:
        want = want.replace(MARK, " ")
    if model.dummy_prefix:
        want = want[1:]
    return model.decode(ids) == want


def decode_ids(tokens: DataFrame, ids_col: str = "ids", into: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """Adds the text of each id array; null arrays give null, empty ones an empty text. Other columns pass unchanged."""
    if into in tokens.columns:
        raise ValueError("the new column must not clash with a column of the table")
    data = tokens.sparkSession.sparkContext.broadcast(read_model(model_path))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields] + [f"`{into}` string"]

    @shared.tidy
    def run(batches):
        model = _model(data.value)
        for batch in batches:
            yield batch.assign(**{into: [None if i is None else model.decode(list(i)) for i in batch[ids_col]]})

    return tokens.mapInPandas(run, ", ".join(fields))


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_ids and round_trip (decoding gives the text again) of each whole text.

    A null text has null ids, no round trip and 0 ids; an empty one has empty
    ids. Of paths of equal score the one with the longer last piece is taken,
    at each place. Repeated rows are encoded each; an empty table gives no
    rows; extra columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = encode_texts(slim, model_path=model_path, check="round_trip")
    return out.select("doc_id", "ids", F.size("ids").alias("n_ids"), "round_trip").withColumn(
        "n_ids", F.when(F.col("ids").isNull(), F.lit(0)).otherwise(F.col("n_ids"))
    )
