"""Writers: staging, ledger, summary tables, exports and their bookkeeping."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.layout import FIELD_COUNT, FIELD_POSITIONS, padded_fields
from ledgerloom.operators.numbering import join_keys


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str], sort_by: Sequence[str] = ()) -> None:
    """Overwrite just the partitions present in ``df``; a rerun is idempotent.

    With ``sort_by`` rows are range-shuffled by partition and sort columns
    together, so a large month is written by many tasks; the columns should
    tell rows apart. Without it every task writes its own rows as they are.
    """
    if sort_by:
        keys = [*partition_by, *sort_by]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("je_month", F.trunc("je_date", "MM").cast("date"))


def replace_run(
    df: DataFrame, path: str, run_id: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()
) -> None:
    """Write the rows of one run to its own folder; a rerun replaces what the run wrote, and nothing else."""
    keys = [*partition_by, *sort_by]
    df = df.drop("run_id")
    if keys:
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(
        f"{path}/run_id={run_id}"
    )


def read_runs(spark: SparkSession, path: str, schema) -> DataFrame:
    """All runs below ``path``; the schema keeps run ids text, whatever they look like."""
    return spark.read.schema(schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at ``path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def drop_partitions(spark: SparkSession, path: str, column: str, gone: Callable[[str], bool]) -> None:
    """Remove the partitions of ``path`` whose value, as written in the folder's name, is ``gone``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in files.listStatus(hadoop):
        name, _, value = entry.getPath().getName().partition("=")
        if name == column and gone(value):
            files.delete(entry.getPath(), True)


def post_lines(lines: DataFrame, path: str, run_id: str) -> None:
    """Ledger lines of one run below their month, in date order."""
    replace_run(with_month(lines), path, run_id, ["je_month"], ["je_date", "je_id", "line_no"])


def new_rows(df: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``existing``; of repeated keys the first by ``order``."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    one = one.select(*keys, *[F.col("_b")[c].alias(c) for c in rest]).select(*df.columns)
    return join_keys(one, existing.select(*keys).distinct(), keys, "left_anti")


def with_mark(df: DataFrame, ids: DataFrame, key: str, flag: str, at: str, when: Column) -> DataFrame:
    """Set ``flag`` and its time for the listed keys; others keep their values."""
    hit = ids.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    found = F.coalesce("_hit", F.lit(False))
    return (
        df.join(hit, F.col(key) == F.col("_k"), "left")
        .withColumn(at, F.when(found, when).otherwise(F.col(at)))
        .withColumn(flag, F.col(flag) | found)
        .drop("_k", "_hit")
    )


def export_lines(
    vouchers: DataFrame,
    lines: DataFrame,
    start: date,
    end: date,
    journal_types: Sequence[str] | None = None,
    include_exported: bool = False,
) -> DataFrame:
    """Lines of the selected vouchers with ``_day``, ``voucher_no`` and only the columns the 57 fields are made of.

    ``lines`` have either a ``fields`` array or the named line columns.
    """
    picked = vouchers.where(F.col("journal_date").between(F.lit(start), F.lit(end)))
    if journal_types:
        picked = picked.where(F.col("journal_type").isin(list(journal_types)))
    if not include_exported:
        picked = picked.where(~F.col("exported"))
    lines = lines.drop("journal_date")
    used = ["fields"] if "fields" in lines.columns else [c for c in FIELD_POSITIONS if c in lines.columns]
    rows = lines.join(picked.select("voucher_id", F.col("journal_date").alias("_day")), "voucher_id")
    return rows.select("_day", "voucher_no", *used)


def _slots(rows: DataFrame) -> list[Column]:
    """The 57 text columns of ``export_lines`` rows; they are wide, so they are made after the last shuffle."""
    if "fields" in rows.columns:
        return [F.get("fields", F.lit(i)) for i in range(FIELD_COUNT)]
    slots = [F.lit("")] * FIELD_COUNT
    for name, at in FIELD_POSITIONS.items():
        if name in rows.columns:
            slots[at] = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return slots


def export_fields(rows: DataFrame) -> DataFrame:
    if "fields" in rows.columns:
        rows = rows.withColumn("fields", padded_fields(F.col("fields")))
    return rows.select("_day", "voucher_no", *[c.alias(f"field_{i:02d}") for i, c in enumerate(_slots(rows))])


def export_rows(
    vouchers: DataFrame,
    lines: DataFrame,
    start: date,
    end: date,
    journal_types: Sequence[str] | None = None,
    include_exported: bool = False,
) -> DataFrame:
    """57 text columns per voucher line of the selected vouchers."""
    return export_fields(export_lines(vouchers, lines, start, end, journal_types, include_exported))


def write_export(rows: DataFrame, path: str) -> None:
    """Headerless CSV part files from ``export_lines``; ordered by day and voucher over the parts."""
    laid = rows.repartitionByRange("_day", "voucher_no").sortWithinPartitions("_day", "voucher_no", _slots(rows)[3])
    export_fields(laid).drop("_day", "voucher_no").write.mode("overwrite").option("header", False).option(
        "emptyValue", ""
    ).csv(path)


def log_run(spark: SparkSession, path: str, run: dict) -> None:
    """Append one row to the run log."""
    schema = "run_id string, journal_type string, status string, record_count bigint, duration_ms bigint, error string"
    row = [tuple(run.get(c) for c in ("run_id", "journal_type", "status", "record_count", "duration_ms", "error"))]
    spark.createDataFrame(row, schema).coalesce(1).withColumn("created_at", F.current_timestamp()).write.mode(
        "append"
    ).parquet(path)


def run_counts(df: DataFrame, run_id: str) -> DataFrame:
    """Run-log rows per journal type."""
    return df.groupBy("journal_type").agg(
        F.lit(run_id).alias("run_id"), F.lit("COMPLETED").alias("status"), F.count(F.lit(1)).alias("record_count")
    )
