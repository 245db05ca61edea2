"""The six raw order tables: CSV source, input check and SQL views."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Ids of orders and users are 64-bit: a 100 TB history passes 2^31 orders.
RAW_SCHEMAS = {
    "orders": (
        "order_id BIGINT, user_id BIGINT, eval_set STRING, order_number INT, order_dow INT, "
        "order_hour_of_day STRING, days_since_prior_order DOUBLE"
    ),
    "order_products_prior": (
        "order_id BIGINT, product_id INT, add_to_cart_order INT, reordered INT"
    ),
    "order_products_train": (
        "order_id BIGINT, product_id INT, add_to_cart_order INT, reordered INT"
    ),
    "products": "product_id INT, product_name STRING, aisle_id INT, department_id INT",
    "aisles": "aisle_id INT, aisle STRING",
    "departments": "department_id INT, department STRING",
}

RAW_FILES = {
    "orders": "orders.csv",
    "order_products_prior": "order_products__prior.csv",
    "order_products_train": "order_products__train.csv",
    "products": "products.csv",
    "aisles": "aisles.csv",
    "departments": "departments.csv",
}


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if the path exists on whatever file system its scheme names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def require_inputs(spark: SparkSession, paths: Iterable[str]) -> None:
    """Stop with one message that lists every missing input."""
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing inputs:\n- " + "\n- ".join(missing))


def read_raw(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """Read the six header CSVs with a fixed schema."""
    paths = {name: f"{directory.rstrip('/')}/{file}" for name, file in RAW_FILES.items()}
    require_inputs(spark, paths.values())
    return {
        name: spark.read.schema(RAW_SCHEMAS[name]).option("header", True).csv(path)
        for name, path in paths.items()
    }


BAD_LINE = "linea"


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV, from its first line."""
    return spark.read.option("header", True).csv(path).columns


def missing_columns(headers: dict[str, list[str]]) -> dict[str, list[str]]:
    """The columns that the schemas ask for and the files don't have, by table."""
    wanted = {n: StructType.fromDDL(RAW_SCHEMAS[n]).names for n in headers}
    return {n: [c for c in wanted[n] if c not in found] for n, found in headers.items()}


def read_checked(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The six CSVs by their headers, with `linea` and `_rechazada`.

    Columns may come in any order, and further ones are left out. All missing files, and then all missing
    columns, are reported in one message. Every file of a table must have the same header. A line that
    has too few or too many fields, or a value of another type, is in `linea` and is marked.
    """
    paths = {name: f"{directory.rstrip('/')}/{file}" for name, file in RAW_FILES.items()}
    require_inputs(spark, paths.values())
    headers = {name: header(spark, path) for name, path in paths.items()}
    missing = {n: cols for n, cols in missing_columns(headers).items() if cols}
    if missing:
        raise ValueError("missing columns: " + "; ".join(f"{n}: {', '.join(c)}" for n, c in missing.items()))
    out = {}
    for name, path in paths.items():
        types = {f.name: f.dataType for f in StructType.fromDDL(RAW_SCHEMAS[name])}
        fields = [StructField(c, types.get(c, StringType())) for c in headers[name]]
        rows = (
            spark.read.schema(StructType([*fields, StructField(BAD_LINE, StringType())]))
            .options(header=True, enforceSchema=False, mode="PERMISSIVE", escape='"')
            .option("columnNameOfCorruptRecord", BAD_LINE)
            .csv(path)
        )
        out[name] = rows.select(*types, BAD_LINE, F.col(BAD_LINE).isNotNull().alias("_rechazada"))
    return out


def sample_of_rejected(table: DataFrame, n: int = 3) -> list[str]:
    """A few lines for a message."""
    return [r[BAD_LINE] for r in table.where("_rechazada").select(BAD_LINE).limit(n).collect()]


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
