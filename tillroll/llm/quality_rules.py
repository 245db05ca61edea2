"""Quality rules: counts of each text, and the frequency of its lines across the documents of a host.

Normalised lines are hashed, distinct documents are counted per host and hash, lines above the limits
are taken away, and documents that lose most of their text are rejected. The others come out without
these lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import digest, line_key, saved
from tillroll.llm.line_dedup import reassembled

SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
STAT_NAMES = [c.split()[0] for c in STATS.split(", ")]
NEW = [*STAT_NAMES, "base_failed", "n_removed_lines", "removed_share", "kept", "kept_text"]


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three words that occurs twice or more in the text, the first included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, window, count = np.unique(
        pair[:-1].astype(np.int64) * len(number) + ids[2:], return_inverse=True, return_counts=True
    )
    starts = count[window] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : shift + len(starts)] |= starts
    return int(inside.sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    raw = (text or "").encode()
    words = raw.split()  # bytes split at exactly the blanks \x20 and \x09-\x0D
    chars = len(b"".join(words).decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, repeats = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line.split(None, 1):
            seen.add(line)
    return len(words), chars, symbols, repeats, repeated_words(words)


def _stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_stats(t) for t in texts], columns=STAT_NAMES)


def host_lines(docs: DataFrame, host: str) -> DataFrame:
    """One row per line with a word: doc_id, host, content (hash of the text), key, chars."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(
        "doc_id",
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        digest(text).alias("content"),
        F.explode(F.split(text, "\n", -1)).alias("line"),
    ).withColumn("line", line_key(F.col("line")))
    return lines.where(F.col("line") != "").select(
        "doc_id", "host", "content", digest(F.col("line")).alias("key"),
        F.char_length("line").cast("long").alias("chars"),
    )


def frequent_lines(docs: DataFrame, host: str, min_docs: int, max_share: float) -> DataFrame:
    """Lines above the limits: host, key and the smallest doc_id on that host that holds the line."""
    lines = host_lines(docs, host)
    distinct = lines.groupBy("host", "key", "content").agg(F.min("doc_id").alias("first_id"))
    counts = (
        distinct.groupBy("host", "key")
        .agg(F.count("*").alias("n_docs"), F.min("first_id").alias("first_id"))
        .where(F.col("n_docs") >= min_docs)
    )
    hosts = (
        docs.select(
            F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
            digest(F.coalesce("text", F.lit(""))).alias("content"),
        )
        .distinct()
        .groupBy("host")
        .agg(F.count("*").alias("host_docs"))
    )
    above = counts.join(hosts, "host").where(F.col("n_docs") > F.col("host_docs") * max_share)
    return above.select("host", "key", "first_id")


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_docs: int = 20,
    max_share: float = 0.01,
    max_removed: float = 0.5,
) -> DataFrame:
    """`docs` with the counts, base_failed, n_removed_lines, removed_share, kept and kept_text.

    Base rule: fewer than `min_words` words, or more than `max_repeat_percent` of the words inside
    repeated three-word windows. Line rule: a line is above the limits if at least `min_docs` distinct
    documents of its host, and more than `max_share` of them, hold it; it is taken away everywhere but
    in the first of these documents. `min_docs` alone decides on hosts of up to min_docs / max_share
    documents; the share keeps the headings of a very large host. A document is depleted, and rejected, if more than
    `max_removed` of the characters of its lines are taken away. kept_text is the text without these
    lines, whether the document is kept or not, and n_removed_lines their number. The counts and the
    base rule are those of the text as it came. Existing columns with the new names are replaced.

    Documents with the same text on a host count as one, so that copies of a page don't make its lines
    look like boilerplate. A null text has no words, fails the base rule and comes out empty; a null host
    is a host of its own. Each row is judged by its own text and host, whatever other rows share its
    doc_id; the rows of the first doc_id keep the line. A row without doc_id is never the first, unless no
    row with the line has one; then all keep it. Other columns of `docs` don't matter.

    Line counts are reduced before each shuffle, so that a line or host with a third of all rows is
    one row per task. The texts move once, to meet the lines that their document loses, and go to Python
    for that only where there are some; for a caller who wants neither kept_text nor n_removed_lines they
    don't move.
    """
    docs = docs.drop(*NEW)
    rows = docs.select("doc_id", F.col(host).alias("host"), "text")
    frequent = saved(frequent_lines(rows, "host", min_docs, max_share), "host-lines")
    marked = host_lines(rows, "host").join(frequent.withColumn("above", F.lit(True)), ["host", "key"], "left")
    gone = F.coalesce("above", F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    removed = (
        marked.groupBy("doc_id", "host", "content")
        .agg(
            F.sum(F.when(gone, F.col("chars")).otherwise(0)).alias("removed"),
            F.sum("chars").alias("total"),
            F.collect_set(F.when(gone, F.col("key"))).alias("_lost"),
        )
        .where("removed > 0")
        .select(
            F.col("doc_id").alias("_lost_id"), F.col("host").alias("_lost_host"),
            F.col("content").alias("_lost_content"), (F.col("removed") / F.col("total")).alias("_lost_share"), "_lost",
        )
    )
    failed = (F.col("n_words") < min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent
    )
    stats = docs.withColumn("_stats", F.pandas_udf(_stats, STATS)("text")).select(*docs.columns, "_stats.*")
    text, own = F.coalesce("text", F.lit("")), F.coalesce(F.col(host).cast("string"), F.lit(""))
    same_row = (
        F.col("doc_id").eqNullSafe(F.col("_lost_id"))
        & (own == F.col("_lost_host"))
        & (digest(text) == F.col("_lost_content"))
    )
    joined = stats.withColumn("base_failed", failed).join(removed, same_row, "left")
    some = F.col("_lost").isNotNull()
    share = F.coalesce("_lost_share", F.lit(0.0))
    out = joined.withColumn("_without", reassembled(1)(F.when(some, text), F.col("_lost")))
    return out.select(
        *[F.col(c) for c in docs.columns],
        *STAT_NAMES,
        "base_failed",
        F.when(some, F.col("_without.n_dropped")).otherwise(F.lit(0)).cast("long").alias("n_removed_lines"),
        share.alias("removed_share"),
        (~F.col("base_failed") & (share <= max_removed)).alias("kept"),
        F.when(some, F.col("_without.kept")).otherwise(text).alias("kept_text"),
    )
