"""A template catalogue for the transactions derived from the given tables."""

from __future__ import annotations

from datetime import date
from decimal import Decimal
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas as K
from ledgerloom.plans.templates import Catalogue, TableCatalogue, load_catalogue

_PREMIUM_HEAD = [
    (1, "DR", "1010", "OP", ":gross_amount", 2, True),
    (2, "CR", "3010", "TBR", ":tabarru_amount", 2, True),
    (3, "CR", "3020", "TNH", ":tanahud_amount", 2, True),
    (4, "CR", "3030", "INV", ":invest_amount", 2, True),
]

_LINES = {
    ("PREM", "1"): [*_PREMIUM_HEAD, (5, "CR", "4010", "OP", ":ujroh_amount + :admin_amount", 2, True)],
    ("PREM", "2"): [
        *_PREMIUM_HEAD,
        (5, "CR", "4010", "OP", ":ujroh_amount", 2, True),
        (6, "CR", "4020", "OP", ":admin_amount", 2, True),
        (7, "CR", "4030", "OP", ":admin_amount", 2, True),
        (8, "CR", "9999", "OP", ":gross_amount", 2, False),
    ],
    ("PREMLIFE", "1"): [
        (1, "DR", "1010", "OP", ":gross_amount", 2, True),
        (2, "CR", "3010", "TBR", "round(:tabarru_amount, 0)", 2, True),
        (3, "CR", "3030", "INV", ":gross_amount - :tabarru_amount", 2, True),
    ],
    ("PREMBIG", "1"): [
        (1, "DR", "1010", "OP", "max(:gross_amount, 0)", 2, True),
        (2, "CR", "3010", "TBR", "min(:gross_amount, 450000)", 2, True),
        (3, "CR", "3030", "INV", ":gross_amount - min(:gross_amount, 450000)", 2, True),
    ],
    ("CLAIM", "1"): [
        (1, "DR", "5010", "TBR", ":tabarru_amount", 2, True),
        (2, "DR", "5020", "INV", ":invest_amount", 2, True),
        (3, "CR", "1010", "OP", ":gross_amount", 2, True),
    ],
}


def _tables(spark: SparkSession) -> tuple[DataFrame, ...]:
    far, start, turn = date(9999, 12, 31), date(1990, 1, 1), date(1997, 1, 1)
    templates = [
        ("PREM", "1", "Premium", "PREMIUM_RECEIPT", "Premium", "JE", start, turn, "ACTIVE"),
        ("PREM", "2", "Premium", "PREMIUM_RECEIPT", "Premium", "JE", turn, far, "ACTIVE"),
        ("PREMLIFE", "1", "Life", "PREMIUM_RECEIPT", "Premium", "JE", start, far, "ACTIVE"),
        ("PREMBIG", "1", "Large", "PREMIUM_RECEIPT", "Premium", "JE", start, far, "ACTIVE"),
        ("CLAIM", "1", "Claim", "CLAIM_PAID", "Claim", "JE", start, far, "ACTIVE"),
        ("OLD", "1", "Old", "PREMIUM_RECEIPT", "Premium", "JE", start, far, "DRAFT"),
    ]
    matches = [
        (1, "PREM", "1", None, None, None, None, None, 100),
        (2, "PREM", "2", None, None, None, None, None, 100),
        (3, "PREMLIFE", "1", "LIFE01", "AGENCY", None, None, None, 100),
        (4, "PREMBIG", "1", None, None, Decimal("450000"), None, ":gross_amount > :tabarru_amount * 3", 10),
        (5, "CLAIM", "1", None, None, None, Decimal("400000"), None, 100),
        (6, "OLD", "1", None, None, None, None, None, 1),
    ]
    lines = [(c, v, *row) for (c, v), rows in _LINES.items() for row in rows]
    conds = [
        ("PREM", "2", 6, "large", ":admin_amount > 5000"),
        ("PREM", "2", 7, "small", ":admin_amount <= 5000"),
    ]
    controls = [
        ("CLAIM", "1", True, Decimal("0.01"), "AUTO_ADJUST", "4099", "OP"),
        ("PREM", "2", True, Decimal("0.01"), "ERROR", None, None),
    ]
    return (
        spark.createDataFrame(templates, K.TEMPLATE),
        spark.createDataFrame(matches, K.TEMPLATE_MATCH),
        spark.createDataFrame(lines, K.TEMPLATE_LINE),
        spark.createDataFrame(conds, K.TEMPLATE_COND),
        spark.createDataFrame(controls, K.TEMPLATE_CONTROL),
    )


@lru_cache(maxsize=1)
def sample_catalogue(spark: SparkSession) -> Catalogue:
    """The catalogue holds plain values, so one load serves the whole session."""
    return load_catalogue(*_tables(spark))


def wide_catalogue(spark: SparkSession, more: int = 100_000) -> TableCatalogue:
    """The sample templates with ``more`` matches of products, channels, amounts and days of their own."""
    templates, matches, *rest = _tables(spark)
    n = F.col("id")
    others = spark.range(more).select(
        (n + 1_000).alias("match_id"),
        F.lit("PREM").alias("template_code"),
        F.lit("1").alias("template_version"),
        F.when(n % 3 > 0, F.concat(F.lit("P"), n.cast("string"))).alias("product_code"),
        F.when(n % 3 != 1, F.concat(F.lit("C"), n.cast("string"))).alias("channel"),
        F.when(n % 2 == 0, (n % 1_000).cast("decimal(20,6)")).alias("min_amount"),
        F.when(n % 4 == 0, (n % 1_000 + 50).cast("decimal(20,6)")).alias("max_amount"),
        F.lit(None).cast("string").alias("condition_expr"),
        F.lit(5).alias("priority"),
    )
    return load_catalogue(templates, matches.unionByName(others), *rest)


@lru_cache(maxsize=1)
def balanced_catalogue(spark: SparkSession) -> Catalogue:
    """Two templates that book every transaction of ``txn_source`` without a remainder."""
    start, far = date(1990, 1, 1), date(9999, 12, 31)
    templates = [
        ("PREM", "1", "Premium", "PREMIUM_RECEIPT", "Premium", "JE", start, far, "ACTIVE"),
        ("CLAIM", "1", "Claim", "CLAIM_PAID", "Claim", "JE", start, far, "ACTIVE"),
    ]
    matches = [(1, "PREM", "1", None, None, None, None, None, 100), (2, "CLAIM", "1", None, None, None, None, None, 100)]
    lines = [(*key, *row) for key in (("PREM", "1"), ("CLAIM", "1")) for row in _LINES[key]]
    controls = [("CLAIM", "1", True, Decimal("0.01"), "AUTO_ADJUST", "4099", "OP")]
    return load_catalogue(
        spark.createDataFrame(templates, K.TEMPLATE),
        spark.createDataFrame(matches, K.TEMPLATE_MATCH),
        spark.createDataFrame(lines, K.TEMPLATE_LINE),
        spark.createDataFrame([], K.TEMPLATE_COND),
        spark.createDataFrame(controls, K.TEMPLATE_CONTROL),
    )
