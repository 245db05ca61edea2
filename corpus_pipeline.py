"""From raw documents to encoded ones: the corpus pipeline.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and returns
a DataFrame; it is written as Parquet and read again as the next stage's documents. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe_tree, decontaminate, line_dedup, near_dup, quality_rules
from tillroll.llm.common import deploy, read, saved


def _aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that a stage uses, and all others in one struct, out of the way of an operator's new names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, *([F.struct(*rest).alias("_rest")] if rest else []))


def _back(out: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `docs` from what `_aside` put into an operator; with a new text, n_chars follows it."""
    rest = out.schema["_rest"].dataType.names if "_rest" in out.columns else []

    def column(c: str) -> Column:
        if c == "text":
            return F.col(text)
        if c == "n_chars" and text != "text":
            return F.char_length(text).cast(docs.schema[c].dataType)
        return F.col("_rest").getField(c) if c in rest else F.col(c)

    return out.select(*[column(c).alias(c) for c in docs.columns])


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a number of its own for each row as `_row`, by doc_id (none last), then by place in the input.

    The sort is by ranges over all executors, and ties are split by where a row was read, so equal rows
    need not meet. The numbers are written, so that they stay.
    """
    placed = docs.withColumn("_place", F.monotonically_increasing_id())
    in_order = placed.sort(F.col("doc_id").asc_nulls_last(), "_place")
    return saved(in_order.withColumn("_row", F.monotonically_increasing_id()).drop("_place"), "numbered-rows")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are above the limits of their host.

    Rows that share a doc_id, or have none, are judged each by its own text.
    """
    deploy(spark)
    out = quality_rules.quality_rules(_aside(docs, "doc_id", "source", "text"))
    return _back(out.where("kept"), docs, "kept_text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents repeat; n_chars follows the text."""
    deploy(spark)
    return _back(line_dedup.dedup_lines(_aside(docs, "doc_id", "text")), docs, "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, and all documents in no group.

    Texts with a similarity of 0.8 are linked. With 22 trees a link of just that is missed with a chance
    of 1.4e-7 at worst; 16 trees, as operator 10 has for 0.85, would miss 1e-5.

    Each row is a document of its own here: of repeated rows one stays, copies without doc_id go like all
    others, and a text that shares its doc_id with a copy stays. The first is the row with the smallest
    doc_id, one without doc_id coming last.
    """
    deploy(spark)
    rows = _numbered(_aside(docs, "doc_id", "text"))
    near = near_dup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), percent=80, trees=22)
    dropped = saved(near.where("NOT kept").select(F.col("doc_id").alias("_dropped")), "dropped")
    return _back(rows.join(dropped, F.col("_row") == F.col("_dropped"), "left_anti"), docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    deploy(spark)
    out = decontaminate.decontaminate(_aside(docs, "doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return _back(out.where("NOT contaminated"), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens, and digests of the ids and of the decoded text."""
    deploy(spark)
    return bpe_tree.encode_decode(docs, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("encoding", encoding),
]

# SQL can't express the merges of the last stage; the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What each stage but the last returns is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
