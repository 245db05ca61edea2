"""Quality classifier learned from trusted positives and unlabelled text.

The model is logistic over counts of the text and their squares. Its risk needs no negatives: with
the class prior p, the losses of unlabelled text as negatives, less p times those of the positives as
negatives, estimate the risk on negatives. With the logistic loss the sum is

    -p * mean over positives of f(x) + mean over unlabelled of log(1 + exp(f(x)))

and convex, so Newton steps find its minimum. The estimated risk on negatives can't be below zero; a
step that brings it there fits the positives too closely and is taken back by halves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import saved

UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
SIGNS = (b"!", b"|", b"#*$%&", b"<>{}[]", b".,;:?", b"\n", b"@/\\_=+~^")
N_BASE = 12 + len(SIGNS)
TOKEN_ENDS = re.compile(rb"[^\sA-Za-z0-9\x80-\xff.,;:?!'\"()-][\s]")


def base_features(text: str | None) -> list[float]:
    """Counts of a text in proportion to its size; all zero for an empty one."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * N_BASE
    n, size = len(words), len(raw)
    deleted = lambda chars: size - len(raw.translate(None, chars))
    distinct = len(set(words))
    pairs = max(n - 1, 1)
    lines = [x for x in raw.split(b"\n") if x]
    return [
        np.log1p(n),
        np.log1p(distinct),
        distinct / n,
        distinct / n**0.8,
        len(set(pairwise(words))) / pairs,
        sum(map(bytes.__eq__, words, words[1:])) / pairs,
        len(b"".join(words)) / n,
        sum(len(w) == 1 for w in words) / n,
        deleted(UPPER) / size,
        deleted(DIGITS) / size,
        len(set(lines)) / max(len(lines), 1),
        len(TOKEN_ENDS.findall(raw)) / n,
        *(np.log1p(10 * deleted(s) / n) for s in SIGNS),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the counts of the whole text, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [base_features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"]
            )

    fields = [docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _design(batch: pa.RecordBatch, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
    z = np.clip((x - centre) / scale, -6, 6)
    return np.hstack([np.ones((len(x), 1)), z, z * z])


class Model:
    def __init__(self, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, prior: float):
        self.weights, self.centre, self.scale, self.prior = weights, centre, scale, prior

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds score, from 0 to 1, to rows with the column x, which goes."""
        kept = [c for c in rows.columns if c != "x"]
        w, centre, scale = self.weights, self.centre, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                f = np.clip(_design(b, centre, scale) @ w, -30, 30) if len(b) else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in kept), pa.array(1 / (1 + np.exp(-f)))], [*kept, "score"]
                )

        fields = [rows.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())]
        return rows.select(*kept, "x").mapInArrow(run, T.StructType(fields))


def _sums(rows: DataFrame, w: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Sums over all rows for one step. Each task adds up its rows, Spark adds up the tasks by place.

    In order: rows, positives, loss of all as negatives, loss of positives as negatives, sum of
    positives, gradient and curvature of all.
    """
    d = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 + 2 * d + d * d)
        for batch in batches:
            if not len(batch):
                continue
            x = _design(batch, centre, scale)
            f = np.clip(x @ w, -30, 30)
            chance, loss = 1 / (1 + np.exp(-f)), np.log1p(np.exp(f))
            positive = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
            curve = (x * (chance * (1 - chance))[:, None]).T @ x
            total += np.concatenate(
                [[len(x), positive.sum(), loss.sum(), loss[positive].sum()], x[positive].sum(0), chance @ x, curve.ravel()]
            )
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["place", "part"])

    parts = rows.select("x", "positive").mapInArrow(run, "place int, part double")
    out = np.zeros(4 + 2 * d + d * d)
    for place, part in parts.groupBy("place").agg(F.sum("part")).collect():  # as many rows as places
        out[place] = part
    return out


def fit(rows: DataFrame, prior: float, steps: int = 12, ridge: float = 1e-3) -> Model:
    """Minimise the non-negative risk over rows with x and positive; all rows are the unlabelled text."""
    places = [F.element_at("x", i + 1) for i in range(N_BASE)]
    got = rows.agg(*map(F.avg, places), *map(F.stddev_pop, places)).first()
    numbers = np.array([v or 0.0 for v in got])
    centre, scale = numbers[:N_BASE], numbers[N_BASE:]
    scale = np.where(scale > 1e-9, scale, 1.0)
    d = 1 + 2 * N_BASE
    w, step = np.zeros(d), np.zeros(d)
    for _ in range(steps):
        s = _sums(rows, w, centre, scale)
        n, n_pos = s[0], s[1]
        if not n or not n_pos:
            break
        if s[2] / n - prior * s[3] / n_pos < 0:  # the risk on negatives is below zero
            step = step / 2
            w = w - step
            continue
        gradient = s[4 + d : 4 + 2 * d] / n - prior * s[4 : 4 + d] / n_pos + ridge * w
        curve = s[4 + 2 * d :].reshape(d, d) / n + ridge * np.eye(d)
        step = -np.linalg.solve(curve, gradient)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return Model(w, centre, scale, prior)


def estimate_prior(labels: DataFrame) -> float:
    """The share of positives among labelled rows, which are taken to be a fair sample of the text."""
    n, n_pos = labels.agg(F.count("quality"), F.sum((F.col("quality") == 1).cast("long"))).first()
    return ((n_pos or 0) + 1) / ((n or 0) + 2)


def classify(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`.

    Labels are learned only from rows that aren't held out; text of all rows is the unlabelled part.
    A document with several labels is a positive if all of them are. A null text is empty; an empty
    one has a score too. Without any positive each score is 0.5. Rows with the same or no doc_id are
    scored by their own text; other columns don't matter, nor do labels of unknown documents.

    The texts stay where they are; counts of 19 numbers a row are stored once, and each step adds up
    1600 sums over all of them. There is no sample and no bound on rows.
    """
    learned = (
        labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    prior = estimate_prior(learned) if prior is None else prior
    positives = learned.where("quality = 1").select("doc_id", F.lit(True).alias("positive"))
    known = features(docs).join(positives, "doc_id", "left")
    rows = saved(known.withColumn("positive", F.coalesce("positive", F.lit(False))), "features")
    model = fit(rows, prior)
    scored = model.score(rows.select("doc_id", "x"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
