"""Fixed schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_CONFIG = (
    "struct<journal_line_number:int,process_line_number:int,account_code:string,d_c_marker:string,"
    "data_idx:int,account_flag:int,transaction_amount:decimal(20,2),"
    + ",".join(f"t{i}_code:string" for i in range(1, 11))
    + ">"
)

JOURNAL_SET = f"struct<ds:int,start_period:date,end_period:date,row:array<{LINE_CONFIG}>>"

JOURNAL_SETTING = (
    f"journal_type string, description string, status int, status2 int, journal_set {JOURNAL_SET}"
)

DATASOURCE_ROW = (
    "id string, journal_type string, journal_source string, journal_number string,"
    " journal_line_number string, transaction_reference string, accounting_period string,"
    " transaction_date string, account_code array<string>, description string, currency_code string,"
    " transaction_amount array<decimal(20,6)>, currency_rate decimal(20,6), base_amount string,"
    " d_c_marker string, asset_indicator string, asset_code string, asset_sub_code string, "
    + ", ".join(f"t{i} array<string>" for i in range(1, 11))
    + ", "
    + ", ".join(f"general_description_{i} string" for i in range(1, 7))
    + ", due_date string"
)

TXN_SOURCE = (
    "source_rowid string, txn_type string, policy_no string, product_code string, channel string,"
    " bank_value_date date, txn_month date, currency string, gross_amount decimal(20,6),"
    " tabarru_amount decimal(20,6), tanahud_amount decimal(20,6), invest_amount decimal(20,6),"
    " ujroh_amount decimal(20,6), admin_amount decimal(20,6)"
)

TEMPLATE = (
    "template_code string, template_version string, title string, txn_type string,"
    " description_pattern string, je_type string, effective_date date, expiry_date date, status string"
)
TEMPLATE_MATCH = (
    "match_id bigint, template_code string, template_version string, product_code string, channel string,"
    " min_amount decimal(20,6), max_amount decimal(20,6), condition_expr string, priority int"
)
TEMPLATE_LINE = (
    "template_code string, template_version string, line_no int, side string, account_code string,"
    " fund_code string, amount_expr string, amount_round int, is_active boolean"
)
TEMPLATE_COND = (
    "template_code string, template_version string, line_no int, cond_name string, cond_expr string"
)
TEMPLATE_CONTROL = (
    "template_code string, template_version string, require_balanced boolean,"
    " tolerance_amount decimal(20,6), balancing_mode string, balancing_account string, balancing_fund string"
)

POSTING_PERIOD = (
    "period_date date, status string, opened_by bigint, opened_date timestamp_ntz,"
    " closed_by bigint, closed_date timestamp_ntz"
)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Select and cast to ``schema``; absent columns become NULL."""
    fields = T.DataType.fromDDL(schema).fields
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def union_sources(frames: list[DataFrame], schema: str = DATASOURCE_ROW) -> DataFrame:
    """All sources under the common contract."""
    first, *rest = [conform(f, schema) for f in frames]
    for frame in rest:
        first = first.unionByName(frame)
    return first
