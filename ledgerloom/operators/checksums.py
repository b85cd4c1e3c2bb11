"""Source checksums that do not need one ordered pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = 4
_DIGITS = 15


def _word(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 1 + i * _DIGITS, _DIGITS), 16, 10).cast("decimal(20,0)")


def row_digest(key: Column, amount: Column) -> Column:
    return F.sha2(F.concat(key.cast("string"), F.lit(":"), amount.cast("string")), 256)


def source_checksum(df: DataFrame, key: str, amount: str, by: Sequence[str] = ()) -> DataFrame:
    """Order-independent digest of all (key, amount) rows.

    Row digests are added word by word, so partial sums combine before the
    shuffle; the sums and the count are digested once more.
    """
    digest = row_digest(F.col(key), F.col(amount))
    sums = [F.sum(_word(F.col("_d"), i)).cast("decimal(38,0)").alias(f"w{i}") for i in range(_WORDS)]
    out = df.select(*by, digest.alias("_d")).groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), *sums)
    text = F.concat_ws(
        ":", F.col("row_count").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(_WORDS)]
    )
    return out.withColumn("checksum", F.sha2(text, 256)).select(*by, "row_count", "checksum")


def bucket_checksums(df: DataFrame, key: str, amount: str, width: int = 1000) -> DataFrame:
    """Ordered digest per range of ``width`` consecutive unique integer keys."""
    item = F.struct(F.col(key).alias("k"), F.concat(F.col(key).cast("string"), F.lit(":"), F.col(amount).cast("string")).alias("t"))
    return (
        df.groupBy(F.floor(F.col(key) / F.lit(width)).alias("bucket"))
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select(
            "bucket",
            F.size("items").alias("row_count"),
            F.sha2(F.array_join(F.transform("items", lambda x: x["t"]), ""), 256).alias("checksum"),
        )
    )
