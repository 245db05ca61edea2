"""BPE encoding and decoding, with tree concatenation for long unsplit text.

Words, and texts that blanks split, are encoded by the library. A word without a blank for very long
is cut into leaves that are encoded in parallel, as rows of their own, and then joined two by two. At
each join a window of the last tokens of the left side and the first of the right side is encoded
again. If its first token is still the first of the window on the left, and its last one the last on
the right, all neighbours in the joined sequence belong together as the merges give them, and the
sequence is exactly that of the whole; otherwise the window grows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import digest
from tillroll.llm.vocabulary import description, load, specials

OUTPUTS = {
    "n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(),
    "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
}
LEAF_CHARS = 1 << 15
LONG_WORD = 1024


@functools.lru_cache(maxsize=2)
def inner_model(name: str):
    """The merges without a mark for the end of a word, for text that goes on behind it."""
    from tokenizers.models import BPE

    model = description(name)["model"]
    return BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]])


class TreeJoiner:
    """Joins the tokens of neighbouring parts of one word."""

    def __init__(self, name: str, window: int = 4):
        self.model, self.inner, self.window = load(name).model, inner_model(name), window
        self.mark = description(name)["model"].get("end_of_word_suffix") or ""

    def encode(self, text: str, ends: bool) -> list[str]:
        model = self.model if ends else self.inner
        return [t.value for t in model.tokenize(text)]

    def join(self, left: list[str], right: list[str], ends: bool) -> list[str]:
        """Tokens of the concatenation. `ends` tells that the right side ends the word."""
        size = self.window
        while True:
            a, b = left[-size:], right[:size]
            last = ends and size >= len(right)
            text = "".join(a + b)
            if last and self.mark:
                text = text[: -len(self.mark)]
            seen = self.encode(text, last)
            left_agrees = size >= len(left) or seen[0] == a[0]
            right_agrees = size >= len(right) or seen[-1] == b[-1]
            if left_agrees and right_agrees:
                return left[: len(left) - len(a)] + seen + right[len(b) :]
            size *= 2

    def tree(self, leaves: list[list[str]]) -> list[str]:
        """Tokens of a word from those of its leaves, in a balanced tree."""
        while len(leaves) > 1:
            n = len(leaves)
            leaves = [
                self.join(leaves[i], leaves[i + 1], i + 2 >= n) if i + 1 < n else leaves[i] for i in range(0, n, 2)
            ]
        return leaves[0]


class WordEncoder:
    """Texts as the library encodes and decodes them; words seen before are looked up.

    The vocabulary's pattern never goes across a blank, so a text is cut at spaces and line feeds. Words
    are known in two generations: when the young one is full it becomes the old one, and an old word that
    is met again moves back, so that frequent words stay. A known word is a few bytes of ids; numbers and
    names of ids come from two tables.
    """

    def __init__(self, name: str, cached: int = 250_000):
        self.tok, self.cached = load(name), cached
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.kind = "H" if size <= 1 << 16 else "I"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.number = [str(i) for i in range(size)]
        self.name = [""] * size
        for token, i in vocabulary.items():
            self.name[i] = token

    def encode(self, text: str) -> array:
        words = text.replace("\n", " ").split(" ")
        try:
            return array(self.kind, b"".join(map(self.young.__getitem__, words)))
        except KeyError:
            return array(self.kind, b"".join(self._learn(words)))

    def _learn(self, words: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        new = []
        for word in {w for w in words if w not in young}:
            if (known := old.get(word)) is not None:
                young[word] = known
            else:
                new.append(word)
        for word, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
            young[word] = array(self.kind, e.ids).tobytes()
        out = [young[w] for w in words]
        if len(young) > self.cached:
            self.old, self.young = young, {}
        return out

    def shown(self, ids: Sequence[int]) -> str:
        return " ".join(map(self.number.__getitem__, ids))

    def decoded(self, ids: Sequence[int]) -> str:
        return " ".join(map(self.name.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def worker_encoder(name: str) -> WordEncoder:
    """One encoder per Python worker, so that tasks after the first find most words known."""
    return WordEncoder(name)


def _row(ids: list[int], shown: str, decoded: str, outputs: Sequence[str]) -> list:
    made = {"n_tokens": lambda: len(ids), "ids": lambda: list(ids), "decoded": lambda: decoded,
            "ids_sha256": lambda: hashlib.sha256(shown.encode()).hexdigest(),
            "decoded_sha256": lambda: hashlib.sha256(decoded.encode()).hexdigest()}
    return [made[o]() for o in outputs]


def _encode_texts(docs: DataFrame, vocabulary: str, outputs: Sequence[str]) -> DataFrame:
    """doc_id and the outputs of texts that need no cutting."""
    fields = [T.StructField(o, OUTPUTS[o]) for o in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = encoder.encode(text or "")
                rows.append(_row(ids, encoder.shown(ids), encoder.decoded(ids), outputs))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *outputs])

    arrow = [_arrow(f.dataType) for f in fields]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields]))


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa.int32())
    return pa.int64() if isinstance(kind, T.LongType) else pa.string()


def cut(text: str, name: str, leaf: int, word_leaf: int) -> Iterator[tuple[str, str]]:
    """(kind, part) of a long text in order: text, special, word, inner and last.

    text is cut at spaces; inner parts and a last one are the leaves of a long word; word is a short
    piece beside one. The last three are in byte letters.
    """
    tok, marks = load(name), specials(name)
    begin = 0
    spans = re.finditer(r"[^ \n]{%d,}" % (word_leaf + 1), text)
    for m in [*spans, None]:
        plain = text[begin : m.start() if m else len(text)]
        at = 0
        while at < len(plain):
            end = at + leaf
            if end < len(plain):
                space = max(plain.rfind(" ", at, end), plain.rfind("\n", at, end))
                end = space if space > at else end_of_word(plain, end)
            yield "text", plain[at:end]
            at = end
        if m is None:
            return
        begin = m.end()
        for part in re.split("(" + "|".join(map(re.escape, marks)) + ")", m[0]) if marks else [m[0]]:
            if part in marks:
                yield "special", part
                continue
            normal = tok.normalizer.normalize_str(part) if tok.normalizer else part
            for piece, _ in tok.pre_tokenizer.pre_tokenize_str(normal) if part else ():
                if len(piece) <= word_leaf:
                    yield "word", piece
                    continue
                for i in range(0, len(piece), word_leaf):
                    yield ("inner" if i + word_leaf < len(piece) else "last"), piece[i : i + word_leaf]


def end_of_word(text: str, at: int) -> int:
    found = [i for i in (text.find(" ", at), text.find("\n", at)) if i >= 0]
    return min(found, default=len(text))


def _encode_long(docs: DataFrame, vocabulary: str, outputs: Sequence[str], leaf: int, word_leaf: int) -> DataFrame:
    """content and the outputs of each distinct long text."""
    texts = docs.select(digest(F.col("text")).alias("content"), "text").dropDuplicates(["content"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, text in zip(batch.column("content").to_pylist(), batch.column("text").to_pylist()):
                parts = list(cut(text, vocabulary, leaf, word_leaf))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([content] * len(parts), pa.binary()), pa.array(range(len(parts)), pa.int64()),
                     pa.array([k for k, _ in parts], pa.string()), pa.array([t for _, t in parts], pa.string())],
                    ["content", "pos", "kind", "part"],
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, joiner = worker_encoder(vocabulary), TreeJoiner(vocabulary)
        for batch in batches:
            tokens = []
            for kind, part in zip(batch.column("kind").to_pylist(), batch.column("part").to_pylist()):
                if kind == "text":
                    tokens.append([encoder.name[i] for i in encoder.encode(part)])
                elif kind == "special":
                    tokens.append([part])
                else:
                    tokens.append(joiner.encode(part, kind != "inner"))
            columns = [batch.column(c) for c in ("content", "pos", "kind")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(tokens, pa.list_(pa.string()))], ["content", "pos", "kind", "tokens"]
            )

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        joiner, tok = TreeJoiner(vocabulary), load(vocabulary)
        rows = rows.sort_values("pos")
        out, waiting = [], []
        for kind, tokens in zip(rows["kind"], rows["tokens"]):
            if kind in ("inner", "last"):
                waiting.append(list(tokens))
                if kind == "last":
                    out += joiner.tree(waiting)
                    waiting = []
            else:
                out += list(tokens)
        ids = [tok.token_to_id(t) for t in out]
        row = _row(ids, " ".join(map(str, ids)), " ".join(out), outputs)
        return pd.DataFrame([[rows["content"].iloc[0], *row]], columns=["content", *outputs])

    parts = texts.mapInArrow(leaves, "content binary, pos long, kind string, part string")
    # leaves of one text go to many tasks, and meet again only as tokens of one row
    encoded = parts.repartition(F.col("content"), F.col("pos")).mapInArrow(
        encode, "content binary, pos long, kind string, tokens array<string>"
    )
    schema = T.StructType([T.StructField("content", T.BinaryType()), *(T.StructField(o, OUTPUTS[o]) for o in outputs)])
    return encoded.groupBy("content").applyInPandas(join, schema)


def encode_decode(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    outputs: Sequence[str] = ("n_tokens", "ids", "decoded"),
    leaf: int = LEAF_CHARS,
    long_word: int = LONG_WORD,
) -> DataFrame:
    """doc_id and the outputs of each text: n_tokens, ids, decoded, ids_sha256, decoded_sha256.

    The ids are those of the library without added special tokens, and decoded is what it makes of
    them. For vocabularies that drop blanks, and have no decoder: their tokens are shown with a space
    between. A null text is empty and has no tokens. One row comes out for each row of `docs`,
    repeated or without doc_id as it is; other columns don't matter.

    Texts above `leaf` code points, or with a word above `long_word`, are cut into leaves, which are
    encoded in parallel; equal long texts are encoded once. All others are encoded where they are.
    """
    outputs = list(outputs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = (F.char_length("text") > leaf) | F.col("text").rlike(r"(?:^|[ \n])[^ \n]{%d}" % (long_word + 1))
    short = _encode_texts(rows.where(~long), vocabulary, outputs)
    found = _encode_long(rows.where(long), vocabulary, outputs, leaf, long_word)
    whole = rows.where(long).select("doc_id", digest(F.col("text")).alias("content")).join(found, "content")
    return short.unionByName(whole.drop("content"))
