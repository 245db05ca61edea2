"""Registered queries: name -> Spark job, and the SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.plans import oracle
from tillroll.plans.workspace import Workspace, workspace

DIGITS = 9


@dataclass(frozen=True)
class Query:
    job: Callable[[Workspace], DataFrame]
    sql: str | None = None
    floats: tuple[str, ...] = ()


REGISTRY: dict[str, Query] = {}


def add(
    name: str, job: Callable[[Workspace], DataFrame], sql: str | None = None, floats: str = ""
) -> None:
    """`floats` names the double columns, blank separated."""
    if name in REGISTRY:
        raise ValueError(f"query {name} is registered twice")
    REGISTRY[name] = Query(job, sql, tuple(floats.split()))


def rounded(df: DataFrame) -> DataFrame:
    """Double columns at nine decimals, so that summation order does not show."""
    doubles = {n: F.round(n, DIGITS) for n, t in df.dtypes if t == "double"}
    return df.withColumns(doubles) if doubles else df


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: rounded(query.job(workspace(spark, sf_dir)))

    return {name: bind(q) for name, q in REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    return {
        name: oracle.sql(q.sql, q.floats, DIGITS)
        for name, q in REGISTRY.items()
        if q.sql is not None
    }
