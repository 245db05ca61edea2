"""Removal of repeated byte strings, by a depth-limited radix sort of the suffixes of all texts.

Suffixes only matter through their first `size` bytes. They are told apart in passes, from the most
significant digit on, and a group is dropped as soon as nothing in it can repeat:

    pass 1, 2   the digit of a suffix is the smallest hash among the strings of 32 (then 80) bytes within
                its first `size` bytes, so equal suffixes have equal digits. Neighbouring suffixes with
                one digit form a run, which stays together: a run of equal bytes as an earlier run is
                settled as repeated, a digit with one run is settled as unique.
    pass 3      the digit is all `size` bytes; equal groups are exactly the repeated strings.

Only the first of equal runs, where its digit has other runs, goes into the next pass. Sorting within
a digit is by the hash of the run and then by place, so each group is read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm import rolling
from tillroll.llm.common import digest, release, saved

SLICE = 1 << 20
RUN_BITS = 16  # a place is where a run begins and, in the last bits, how many suffixes it has


def runs(data: np.ndarray, lengths: np.ndarray, size: int, depth: int) -> tuple[np.ndarray, ...]:
    """digit, hash of all bytes, stretch, begin, number of suffixes, and whether it is known to repeat.

    `data` are the bytes of stretches with `lengths` suffixes each, one behind the other; begin counts
    from the start of the run's stretch. A run ends where the leftmost smallest string changes its
    place, so no two of its suffixes are equal: their distances to that place differ. A run that equals
    an earlier one is known to repeat; such neighbours become one row with a digit of its own.
    """
    hashes = rolling.windows(rolling.prefix_sums(data), depth)
    digits = rolling.sliding_min(hashes, size - depth + 1)
    n = len(digits)
    offset = np.cumsum(lengths + size - 1) - (lengths + size - 1)
    inside = np.zeros(n + size, np.int8)
    inside[offset] += 1
    inside[offset + lengths] -= 1
    new = np.ones(n, bool)
    new[1:] = (digits[1:] != digits[:-1]) | (hashes[: n - 1] == digits[:-1])
    new[offset] = True
    at = np.flatnonzero(new & (np.cumsum(inside[:n], dtype=np.int8) > 0))
    stretch = np.searchsorted(offset, at, "right") - 1
    count = np.minimum(np.append(at[1:], n), (offset + lengths)[stretch]) - at
    sums = rolling.prefix_sums(data, rolling.BASES[1])
    whole = rolling.ranges(sums, at, at + count + size - 1, rolling.BASES[1])
    digit = digits[at]
    _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
    first = first[inverse]
    known = (first < np.arange(len(at))) & (digit[first] == digit)
    if known.any():
        follows = known[1:] & known[:-1] & (stretch[1:] == stretch[:-1])
        head = np.flatnonzero(np.concatenate([[True], ~follows]))
        end = (at + count)[np.append(head[1:], len(at)) - 1]
        at, known, digit, whole, stretch = at[head], known[head], digit[head], whole[head], stretch[head]
        count = end - at
        digit = np.where(known, rolling.mix(digit + at.astype(np.uint64)), digit)
    return digit, whole, stretch, at - offset[stretch], count, known


def bounded(begin: int, count: int) -> list[int]:
    """Places for any number of suffixes."""
    step = (1 << RUN_BITS) - 1
    return [at << RUN_BITS | min(step, begin + count - at) for at in range(begin, begin + count, step)]


def portions(stretches: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Stretches in portions of bounded size; a long one is cut."""
    portion, total = [], 0
    for begin, end in stretches:
        for at in range(begin, end, SLICE):
            stop = min(at + SLICE, end)
            if portion and total + stop - at > SLICE:
                yield portion
                portion, total = [], 0
            portion.append((at, stop))
            total += stop - at
    if portion:
        yield portion


def _runs_of(size: int, depth: int):
    """Rows of texts, with the places that are still open, to runs."""

    def of_text(key: int, text: str, places: list[int] | None) -> Iterator[tuple[np.ndarray, ...]]:
        data = np.frombuffer(text.encode(), np.uint8)
        last = len(data) - size + 1
        if last <= 0:
            return
        for portion in portions([(0, last)] if places is None else merged(np.array(places, np.int64))):
            begins = np.array([b for b, _ in portion])
            lengths = np.array([e - b for b, e in portion])
            part = [data[b : e + size - 1] for b, e in portion]
            part = np.concatenate(part) if len(part) > 1 else part[0]
            digit, whole, stretch, first, count, known = runs(part, lengths, size, depth)
            first = first + begins[stretch]
            # only runs that are known to repeat are that long: no other is longer than `size`
            long = np.flatnonzero(count >= 1 << RUN_BITS)
            extra = np.array([p for r in long for p in bounded(int(first[r]), int(count[r]))[1:]], np.int64)
            place = first << RUN_BITS | np.minimum(count, (1 << RUN_BITS) - 1)
            yield (
                np.concatenate([digit.view(np.int64), extra]), np.concatenate([whole.view(np.int64), extra]),
                np.full(len(digit) + len(extra), key, np.int64), np.concatenate([place, extra]),
                np.concatenate([known, np.ones(len(extra), bool)]),
            )

    def batch_of(waiting: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(c)) for c in zip(*waiting)]
        return pa.RecordBatch.from_arrays(columns, ["digit", "whole", "doc_id", "place", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            places = batch.column("places").to_pylist() if "places" in batch.schema.names else [None] * len(keys)
            for row in zip(keys, texts, places):
                for found in of_text(*row):
                    waiting.append(found)
                    rows += len(found[0])
                    if rows >= 50_000:
                        yield batch_of(waiting)
                        waiting, rows = [], 0
        if waiting:
            yield batch_of(waiting)

    return run


def merged(places: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (begin, end) of neighbouring places, in order."""
    places = np.unique(places)
    begin, count = places >> RUN_BITS, places & ((1 << RUN_BITS) - 1)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], (begin + count)[order]
    reach = np.maximum.accumulate(end)
    first = np.concatenate([[True], begin[1:] > reach[:-1]])
    return list(zip(begin[first].tolist(), reach[np.concatenate([first[1:], [True]])].tolist()))


def radix_pass(texts: DataFrame, size: int, depth: int) -> DataFrame:
    """doc_id, place, repeated: runs that are settled as repeated, and runs that stay open.

    A digit's rows are sorted and read as a stream: a run whose predecessor has the same bytes is
    repeated; a first one stays open if the digit's smallest and largest runs differ.
    """
    schema = "digit long, whole long, doc_id long, place long, known boolean"
    rows = texts.mapInArrow(_runs_of(size, depth), schema)
    by_digit = Window.partitionBy("digit")
    ordered = by_digit.orderBy("whole", "doc_id", "place")
    group = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = rows.select(
        "doc_id",
        "place",
        (F.col("known") | F.coalesce(F.lag("whole").over(ordered) == F.col("whole"), F.lit(False))).alias("repeated"),
        (F.first("whole").over(group) != F.last("whole").over(group)).alias("several"),
    )
    return marked.where("repeated OR several").select("doc_id", "place", "repeated")


def repeated_places(docs: DataFrame, size: int = 100, depths: Sequence[int] = (32, 80)) -> DataFrame:
    """doc_id, content and place of runs of strings that also start earlier.

    Equal texts are searched once, in the row with the smallest doc_id.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    keyed = rows.select("doc_id", "text", digest(F.col("text")).alias("content"))
    firsts = keyed.where(F.octet_length("text") >= size).groupBy("content").agg(F.min("doc_id").alias("first_id"))
    firsts = saved(firsts, "first-copies")
    searched = saved(
        firsts.groupBy("first_id").agg(F.min("content").alias("content")).select("first_id", "content"), "searched"
    )
    copies = (
        keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n"))
        .join(firsts, "content")
        .where(F.col("doc_id") > F.col("first_id"))
    )
    # a copy repeats as one stretch; its places are cut as the number of suffixes of a run is bounded
    step = (1 << RUN_BITS) - 1
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - size, F.lit(step).cast("long"))
    copied = copies.select("doc_id", "content", "n", F.explode(starts).alias("at")).select(
        "doc_id", "content",
        F.shiftleft("at", RUN_BITS).bitwiseOR(F.least(F.col("n") - size + 1 - F.col("at"), F.lit(step))).alias("place"),
    )
    texts = keyed.join(searched, (keyed.content == searched.content) & (keyed.doc_id == searched.first_id)).select(
        keyed.doc_id, "text"
    )
    settled = []
    release(spark)
    for depth in [*depths, size]:
        done = saved(radix_pass(texts, size, depth), f"depth-{depth}")
        release(spark)
        settled.append(done.where("repeated").select("doc_id", "place"))
        still = done.where("NOT repeated").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
        still = still.join(searched, still.doc_id == searched.first_id).select("first_id", "content", "places")
        texts = keyed.join(
            still, (keyed.doc_id == still.first_id) & (keyed.content == still.content)
        ).select(keyed.doc_id, "text", "places")
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    found = found.join(searched, found.doc_id == searched.first_id).select("doc_id", "content", "place")
    return found.unionByName(copied)


def _remove(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                raw = (text or "").encode()
                kept, at, spans = [], 0, 0
                for begin, end in merged(np.array(places, np.int64)) if places else ():
                    end += size - 1
                    if begin > at or not spans:  # else the removed strings touch or overlap
                        kept.append(raw[at:begin])
                        spans += 1
                    at = max(at, end)
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()))
            if rows:
                n, removed, spans, kept, sha = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    return run


def remove_repeats(docs: DataFrame, size: int = 100, depths: Sequence[int] = (32, 80)) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256 for each row of `docs`.

    Texts are UTF-8 bytes. A byte goes if a string of `size` bytes covers it that also starts earlier,
    in a smaller doc_id or before in the same text; overlaps count, and strings never cross texts. What
    is left need not be whole code points. A null text is empty. Rows without doc_id keep everything
    and don't count as earlier. Of different texts with the same doc_id only the one with the smallest
    digest is searched; the others lose bytes only as copies of a text with a smaller doc_id. Other
    columns don't matter.

    Strings are equal if 128 bits of two hashes are. A passage that a third of all texts share makes a
    run per text and digit, about one in a few hundred of all rows for a text of usual length; equal
    texts are searched once.
    """
    places = repeated_places(docs, size, depths).groupBy("doc_id", "content").agg(F.collect_list("place").alias("places"))
    places = saved(places, "places").withColumnsRenamed({"doc_id": "_id", "content": "_content"})
    release(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.withColumn("content", digest(F.col("text"))).join(
        places, (F.col("doc_id") == F.col("_id")) & (F.col("content") == F.col("_content")), "left"
    )
    return joined.select("doc_id", "text", "places").mapInArrow(
        _remove(size),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string",
    )
