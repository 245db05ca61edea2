"""Reading, intermediate tables and column expressions that several operators share."""

from __future__ import annotations

import gc
import os
import string
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.workers import deploy  # noqa: F401

BLANKS = "\t\n\x0b\x0c\r "
WORD_BLANKS = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: spark.checkpoint.dir, which all executors share.

    Where it is unset, as in tests, a folder in the warehouse is used, never a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "work")).rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage, survives lost executors, and gives later joins the true size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs.

    Spark deletes them once nothing on the driver refers to their job, which shows only when memory is
    cleaned. Operators of many jobs call this between them, so that their disk use doesn't add up. The
    second cleaning finds what only the first one's finds referred to.
    """
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    other = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(text)).otherwise(other)


def line_key(line: Column) -> Column:
    """What makes two lines equal: blanks stripped at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def digest(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
