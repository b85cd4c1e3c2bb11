"""Readers of the ledger tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas as K
from ledgerloom.scratch import cut

JSON_FIELDS = ["reference_1", "reference_2", "description"] + [f"general_description_{i}" for i in (1, 2, 3)]


def load_month(spark: SparkSession, path: str, year: int, month: int) -> DataFrame:
    """Transactions of one month; reads only that partition of ``txn_month``."""
    return spark.read.parquet(path).where(F.col("txn_month") == F.lit(date(year, month, 1)))


def unpack_gl(gl: DataFrame) -> DataFrame:
    """Text fields of the JSON column ``data`` as columns, parsed once."""
    schema = "struct<" + ",".join(f"{f}:string" for f in JSON_FIELDS) + ">"
    return gl.withColumn("_d", F.from_json("data", schema)).select(
        *[c for c in gl.columns if c != "data"], *[F.col("_d")[f].alias(f) for f in JSON_FIELDS]
    )


def load_gl_day(spark: SparkSession, path: str, day: date) -> DataFrame:
    """Ledger rows of one day with their JSON fields."""
    return unpack_gl(spark.read.parquet(path).where(F.col("trx_date") == F.lit(day)))


def register_gl_view(gl: DataFrame, name: str = "gl_entries_filtered") -> DataFrame:
    """Typed temporary view; amounts stay decimal."""
    typed = gl.select(
        *[c for c in gl.columns if c not in ("amount",)], F.col("amount").cast("decimal(20,2)").alias("amount")
    )
    typed.createOrReplaceTempView(name)
    return typed


def active_setting_rows(settings: DataFrame) -> DataFrame:
    return settings.where("status = 1")


def read_csv(spark: SparkSession, path: str, schema: str = K.TXN_SOURCE, corrupt: str = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """Typed rows of headed CSV files, and the rows that do not parse.

    The files are parsed once into a scratch table: whether a line parses then
    does not depend on the columns a later query happens to read.
    """
    raw = (
        spark.read.schema(f"{schema}, {corrupt} string")
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", corrupt)
        .csv(path)
    )
    parsed = cut(raw, "csv")
    return parsed.where(F.col(corrupt).isNull()).drop(corrupt), parsed.where(F.col(corrupt).isNotNull())


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
    **options: str,
) -> DataFrame:
    """Parallel ranged read of a database table; filters are pushed down."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
        numPartitions=str(partitions), fetchsize=options.pop("fetchsize", "10000"),
    )
    return reader.options(**options).load()


def create_views(frames: dict[str, DataFrame]) -> None:
    """Compatibility views under the table names of existing queries."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
