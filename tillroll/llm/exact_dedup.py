"""Exact deduplication with skew-safe combining, in DataFrame operations only.

Texts are equal if they are the same without their blanks. Equal rows are combined in three steps, and
each of them groups by the whole normalised text beside its digest, so that unequal texts never meet:

1. locally: each task combines its own rows before anything is shuffled;
2. salted: what is left of a digest goes to as many groups as there are salts;
3. globally: the winners of the salts are combined, at most one row per text and salt.

A group of any size therefore costs a task one row per task before it, split by the salts, and then one
row per salt. The winner of a group is the row with the most code points, then the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import BLANKS, saved, sha256

RANK = "decimal(38,0)"


def normalised(text: Column) -> Column:
    """The text without its blanks; null is the empty text."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """A number that is larger for more code points, then for a smaller doc_id, and lowest without one.

    Numbers have a fixed width, so Spark combines them in hash tables; structs would need sorts.
    """
    behind = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    return (n_chars.cast("decimal(12,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") - behind).cast(RANK)


def _best(keys: list[str], rows: DataFrame) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.max("rank").alias("rank"), F.max_by("keep_id", "rank").alias("keep_id"), F.sum("n").alias("n")
    )


def combine(rows: DataFrame, salts: int) -> DataFrame:
    """digest, content, doc_id, rank -> per digest and content: rank and doc_id of the winner, number of rows.

    Rows of one task share a salt, so that the partial aggregation in the task leaves one row per text.
    """
    one = rows.select(
        "digest", "content", "rank", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
    )
    salted = _best(["digest", "salt", "content"], one)
    return _best(["digest", "content"], salted.drop("salt"))


def _verdicts(rows: DataFrame, winners: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the winner of its group. `rows` has a number `row` that is its own.

    Rows that tie with the winner have its doc_id and length, so they are repeated rows (or have no
    doc_id); the first of them by `row` stays. Groups of one row aren't joined at all: what a row finds
    nothing for is alone.
    """
    shared = winners.where("n > 1").select(*keys, F.col("rank").alias("best"), "keep_id", F.col("n").alias("group_size"))
    found = rows.join(saved(shared, "winners"), keys, "left")
    alone = F.col("best").isNull()
    found = saved(
        found.select(
            *keys, "row", "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (alone | (F.col("rank") == F.col("best"))).alias("first"),
            alone.alias("alone"),
            "text_sha256",
        ),
        "found",
    )
    ties = found.where("first AND NOT alone").groupBy(*keys).agg(F.min("row").alias("_row"), F.count("*").alias("_n"))
    ties = saved(ties.where("_n > 1").drop("_n"), "ties")
    kept = F.col("first") & (F.col("_row").isNull() | (F.col("row") == F.col("_row")))
    return found.join(ties, keys, "left").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_duplicates(
    docs: DataFrame, salts: int = 64, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    `docs` has doc_id and text; other columns don't matter, whatever their names. A null text is empty,
    and all texts of nothing but blanks are one group. Of equal texts the one with the most code points
    stays, blanks included, then the one with the smallest doc_id; a row without doc_id comes last, and
    keep_id is null where only such rows are in the group. Of rows that are the same in text and doc_id
    exactly one is kept. No rows give no rows.

    Where a digest has several contents, its rows are told apart by their contents once more; with
    SHA-256 that doesn't happen, and `digest` is a parameter so that it can be tested.
    """
    content = normalised(F.col("text"))
    length = F.char_length(F.coalesce("text", F.lit("")))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = given.select("doc_id", content.alias("content"), _rank(length, F.col("doc_id")).alias("rank"))
    rows = rows.withColumn("text_sha256", sha256(F.col("content")))
    own = F.unhex("text_sha256") if digest is sha256 else digest(F.col("content"))
    rows = rows.withColumn("digest", own)

    number = F.monotonically_increasing_id().alias("row")
    narrow = saved(rows.select(number, "doc_id", "rank", "digest", "text_sha256"), "rows")
    winners = saved(combine(rows, salts).drop("content"), "texts")
    several = saved(winners.groupBy("digest").count().where("count > 1").select("digest"), "collisions")
    if several.isEmpty():
        return _verdicts(narrow, winners, ["digest"])
    # rows whose digest has several contents are compared by content
    told = saved(rows.join(several, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()), "told")
    rest = _verdicts(
        narrow.join(several, "digest", "left_anti"), winners.join(several, "digest", "left_anti"), ["digest"]
    )
    return rest.unionByName(_verdicts(told, combine(told, salts), ["digest", "content"]))
