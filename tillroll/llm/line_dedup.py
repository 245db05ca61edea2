"""Line deduplication over a corpus.

Lines are exploded and normalised, each long key is hashed, distinct documents are counted per hash,
keys over the threshold are dropped from all but one document, and the rest is put together again in
the order of the lines.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import BLANKS, digest, line_key, saved

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def long_line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """Distinct (doc_id, key) of lines whose normalised form has at least `min_chars` code points."""
    lines = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    keys = lines.where(F.char_length("line") >= min_chars).select("doc_id", line_key(F.col("line")).alias("line"))
    return keys.where(F.char_length("line") >= min_chars).select("doc_id", digest(F.col("line")).alias("key")).distinct()


def frequent_keys(pairs: DataFrame, min_docs: int) -> DataFrame:
    """key -> the largest document that holds it, for keys in at least `min_docs` documents.

    The pairs are distinct, so counting rows counts documents, and the partial counts of a key that
    a third of all documents hold are one row per task.
    """
    counts = pairs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counts.where(F.col("n_docs") >= min_docs)


def reassembled(min_chars: int):
    """(text, keys to drop) -> the text without their lines, and how many lines that were."""

    def one(text: str, dropped: set[bytes]) -> tuple[str, int]:
        kept, lines = [], text.split("\n")
        for line in lines:
            if len(line) >= min_chars:
                key = line.strip(BLANKS).translate(LOWER)
                if len(key) >= min_chars and hashlib.md5(key.encode()).digest() in dropped:
                    continue
            kept.append(line)
        return "\n".join(kept), len(lines) - len(kept)

    @F.pandas_udf("kept string, n_dropped long")
    def reassemble(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, drops in batches:
            rows = [(None, 0) if d is None else one(t, {bytes(x) for x in d}) for t, d in zip(texts, drops)]
            yield pd.DataFrame(rows, columns=["kept", "n_dropped"])

    return reassemble


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """`docs` with the columns kept_text, n_lines and n_dropped.

    A null or empty text is one empty line. A key of at least `min_chars` code points that occurs in
    at least `min_docs` documents loses all its lines except those in the largest doc_id holding it.
    Rows with the same doc_id count as one document. A null doc_id counts as one more document and
    never loses lines. Existing columns with the new names are replaced.

    Only keys of 16 bytes are shuffled to count; the texts move once, to meet the dropped keys of
    their document, and go to Python only where something is dropped.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    pairs = long_line_keys(docs.select("doc_id", "text"), min_chars)
    frequent = saved(frequent_keys(pairs, min_docs).select("key", "keeper"), "frequent-lines")
    dropped = (
        pairs.join(frequent, "key")
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("_drop_id"))
        .agg(F.collect_list("key").alias("_drop_keys"))
    )
    text = F.coalesce("text", F.lit(""))
    joined = docs.join(dropped, F.col("doc_id") == F.col("_drop_id"), "left")
    some = F.col("_drop_keys").isNotNull()
    out = joined.withColumn(
        "_reassembled", reassembled(min_chars)(F.when(some, text), F.col("_drop_keys"))
    )
    return out.select(
        *[F.col(c) for c in docs.columns],
        F.when(some, F.col("_reassembled.kept")).otherwise(text).alias("kept_text"),
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.when(some, F.col("_reassembled.n_dropped")).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )
