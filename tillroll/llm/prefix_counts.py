"""Token counts at every prefix of a text, by dynamic programming over prefixes.

The tokens of a prefix of a word are those of a shorter prefix and one last token. A sequence of
tokens is what the merges give if and only if each two neighbours are what the merges give for their
concatenation. So the last token of the prefix that ends at i is the one token t ending at i whose
neighbour, the last token of the prefix before t, stays apart from it; count[i] = count[i - |t|] + 1.
The library decides about each pair of tokens once.

The counts of a text follow from those of its words. They answer how many tokens any prefix has, and
where to cut for a budget, without encoding again.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillroll.llm.vocabulary import byte_letters, load, specials

# blanks other than space and line feed; texts with one take the general way
OTHER_BLANKS = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
NO_BLANKS = frozenset("\x1c\x1d\x1e\x1f")  # blanks for Python, but not for the vocabulary's pattern

# pieces that the vocabulary's pattern splits in an obvious way, if no blank but a single line feed
# stands between them
SIMPLE_PIECE = r"[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n(?!\n)"
PIECES = re.compile(SIMPLE_PIECE)
ALL_SIMPLE = re.compile(f"(?:{SIMPLE_PIECE})*")


def blank_only(text: str) -> bool:
    return text.isspace() and not NO_BLANKS.intersection(text)


def spaced_simply(text: str) -> bool:
    """Whether the text may be cut before each space: no space has a blank beside it."""
    return not ("  " in text or " \n" in text or "\n " in text or OTHER_BLANKS.search(text))


class PieceSplitter:
    """Splits texts as the pattern of a byte-level vocabulary does."""

    def __init__(self, tok):
        self.tok, self.letters = tok, byte_letters()

    def split(self, text: str) -> list[str]:
        """The words of a text, in byte letters, as the vocabulary's pattern splits it."""
        body = text[1:] if text.startswith(" ") and not text.startswith((" \n", "  ")) else text
        if not body or not ALL_SIMPLE.fullmatch(body):
            return [word for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        words = PIECES.findall(body)
        if not body.isascii():
            letters = self.letters
            words = [w if w.isascii() else "".join([letters[b] for b in w.encode()]) for w in words]
        words = [self.letters[10] if w == "\n" else w for w in words]
        if body is not text:
            words[0] = self.letters[32] + words[0]
        return words


class PrefixCounter:
    """Counts for one byte-level vocabulary. `cached` bounds the words that are remembered."""

    def __init__(self, name: str, cached: int = 500_000):
        self.tok, self.cached = load(name), cached
        self.vocab = self.tok.get_vocab(with_added_tokens=False)
        self.longest = max(map(len, self.vocab))
        self.specials = specials(name)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.split = PieceSplitter(self.tok).split
        self.inner = set(byte_letters()[0x80:0xC0])  # bytes inside a code point
        self.apart: dict[str, dict[str, bool]] = {}
        self.n_apart = 0
        self.pieces: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.total = np.zeros(1 << 12, np.int64)

    def _stays(self, left: str, right: str) -> bool:
        """Whether two tokens are what the merges give for their concatenation."""
        if self.n_apart > 8 * self.cached:
            self.apart, self.n_apart = {}, 0
        self.n_apart += 1
        found = [t.value for t in self.tok.model.tokenize(left + right)] == [x for x in (left, right) if x]
        self.apart.setdefault(left, {})[right] = found
        return found

    def piece(self, word: str) -> list[int]:
        """Counts at the code point ends of a word in byte letters."""
        if word in ("'re", "'ve", "'ll"):  # before its last letter, the rest is not yet one word
            return [1, 1 + self.piece(word[1])[-1], len(self.tok.model.tokenize(word))]
        last, count = [""] * (len(word) + 1), [0] * (len(word) + 1)
        vocab, none = self.vocab, {}
        for end in range(1, len(word) + 1):
            # just one token can be the last, so the order does not matter; most are short
            for begin in range(end - 1, max(0, end - self.longest) - 1, -1):
                token = word[begin:end]
                if token in vocab:
                    left = last[begin]
                    stays = self.apart.get(left, none).get(token)
                    if stays is None:
                        stays = self._stays(left, token)
                    if stays:
                        last[end], count[end] = token, count[begin] + 1
                        break
            else:
                raise ValueError(f"no token ends at {end} of {word!r}")
        return [count[i] for i in range(1, len(word) + 1) if i == len(word) or word[i] not in self.inner]

    def word(self, word: str) -> list[int]:
        found = self.pieces.get(word)
        if found is None:
            found = self.piece(word)
            if len(word) <= 64:
                if len(self.pieces) > self.cached:
                    self.pieces.clear()
                self.pieces[word] = found
        return found

    def plain(self, text: str) -> list[int]:
        """Counts at each code point of a text without special strings."""
        out: list[int] = []
        total, blank, before = 0, "", 0
        for word in self.split(text):
            counts = self.word(word)
            at = len(out)
            out.extend([total + c for c in counts] if total else counts)
            if blank and blank_only(text[at]):
                # until the next character is there, the run of blanks is still one word
                out[at] = before + self.word(blank + word[: self._first(word)])[-1]
            blank, before = (word, total) if text[at].isspace() and blank_only(text[at : len(out)]) else ("", 0)
            total += counts[-1]
        return out

    def _first(self, word: str) -> int:
        return next((i for i in range(1, len(word)) if word[i] not in self.inner), len(word))

    def general(self, text: str) -> np.ndarray:
        """Counts at each code point of any text; a complete special string is one token."""
        out: list[int] = []
        base = at = 0
        for m in self.special.finditer(text) if self.special else ():
            counts = self.plain(text[at : m.end()])  # an incomplete special string is ordinary text
            kept = self.plain(text[at : m.start()])
            total = base + (kept[-1] if kept else 0)
            out += [base + c for c in counts[:-1]] + [total + 1]
            base, at = total + 1, m.end()
        out += [base + c for c in self.plain(text[at:])]
        return np.array(out, np.int32)

    def _learn(self, key: str, text: str) -> int:
        counts, n = self.plain(text), len(self.known)
        if self.used + len(counts) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(counts)), np.int32)])
        if n == len(self.start):
            self.start, self.size, self.total = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size, self.total))
        self.flat[self.used : self.used + len(counts)] = counts
        self.start[n], self.size[n], self.total[n] = self.used, len(counts), counts[-1] if counts else 0
        self.used += len(counts)
        self.known[key] = n
        return n

    def counts(self, text: str) -> np.ndarray:
        """counts[i] tokens for the prefix of i + 1 code points, for each i."""
        if not spaced_simply(text) or self.special and self.special.search(text):
            return self.general(text)
        if len(self.known) > self.cached or self.used > 32 * self.cached:
            self.clear()
        first, *rest = text.split(" ")
        get = self.known.get
        ids = np.fromiter(map(get, rest, repeat(-1)), np.int64, len(rest))
        for i in np.flatnonzero(ids < 0):
            found = get(rest[i])
            ids[i] = self._learn(rest[i], " " + rest[i]) if found is None else found
        head = get(" " + first)
        ids = np.concatenate([[self._learn(" " + first, first) if head is None else head], ids])
        size, total = self.size[ids], self.total[ids]
        base, before = np.cumsum(total) - total, np.cumsum(size) - size
        where = np.arange(size.sum()) + np.repeat(self.start[ids] - before, size)
        return (np.repeat(base, size) + self.flat[where]).astype(np.int32)


@functools.lru_cache(maxsize=2)
def worker_counter(name: str) -> PrefixCounter:
    """One counter per Python worker, so that tasks after the first find most words known."""
    return PrefixCounter(name)


def pack(counts: np.ndarray) -> bytes:
    """Differences from prefix to prefix, in one byte each where they fit, else in four."""
    steps = np.diff(counts, prepend=np.int32(0))
    small = not len(steps) or (steps.min() >= -128 and steps.max() <= 127)
    return bytes([1 if small else 4]) + steps.astype("<i1" if small else "<i4").tobytes()


def unpack(stored: bytes) -> np.ndarray:
    steps = np.frombuffer(stored, "<i1" if stored[0] == 1 else "<i4", offset=1)
    return np.cumsum(steps, dtype=np.int32)


def tokens_at(stored: bytes, length: int) -> int:
    """Tokens of the first `length` code points."""
    counts = unpack(stored)
    return int(counts[min(length, len(counts)) - 1]) if length > 0 and len(counts) else 0


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens."""
    fit = np.flatnonzero(counts <= budget)
    return int(fit[-1]) + 1 if len(fit) else 0


def prefix_counts(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    budgets: Sequence[int] = (1024,),
    store: bool = True,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, fit_<budget> per budget and, if asked for, the stored counts.

    fit_<budget> is the number of code points of the longest prefix within the budget. prefix_counts
    is what `pack` makes. A null text is empty: no bytes, no tokens, nothing stored. One row comes out
    for each row of `docs`, repeated or without doc_id as it is; other columns don't matter. No row
    leaves its task, whatever its size.
    """
    budgets = tuple(budgets)
    longs = ["n_bytes", "n_tokens", *(f"fit_{b}" for b in budgets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(vocabulary)
        for batch in batches:
            numbers, stored = [], []
            for text in batch.column("text").to_pylist():
                counts = counter.counts(text or "")
                row = [len((text or "").encode()), int(counts[-1]) if len(counts) else 0]
                numbers.append(row + [longest_prefix(counts, b) for b in budgets])
                if store:
                    stored.append(pack(counts))
            columns = [batch.column("doc_id")] + [pa.array(c, pa.int64()) for c in zip(*numbers)]
            if store:
                columns.append(pa.array(stored, pa.binary()))
            if numbers:
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", *longs] + ["prefix_counts"] * store
    fields = [docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in longs)]
    fields += [T.StructField("prefix_counts", T.BinaryType())] * store
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
