"""The functions of the journal rules for SQL users, as temporary functions of the session.

``register(spark)`` makes scalar functions and table functions whose bodies are SQL, so the optimizer inlines them like
the column builders of this package, which stay the rule: tests hold both to the same rows. Table functions read the
views or tables named to ``register`` at the time of the call; a table not named has no function. Registering again
replaces the functions. Nulls go through the bodies as in the column builders.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerloom.functions.codes import ACCOUNT_KEYWORDS, DEFAULT_LOCATION_CODE, VOUCHER_SEQUENCE_DIGITS
from ledgerloom.sources.routing import SOURCE_RANGES

_KEYWORDS = "|".join(ACCOUNT_KEYWORDS)
_ROUTES = " ".join(
    "WHEN " + " OR ".join(f"ds BETWEEN {low} AND {high}" for low, high in ranges) + f" THEN {f'{name!r}' if name else 'NULL'}"
    for name, ranges in SOURCE_RANGES
)

#: (signature, return type, body) of the scalar functions.
SCALARS = [
    ("tcode(setting STRING, vals ARRAY<STRING>, idx INT DEFAULT 0)", "STRING",
     "CASE WHEN trim(coalesce(setting, get(vals, idx))) = '' THEN 'N/A' ELSE coalesce(setting, get(vals, idx)) END"),
    ("account_code(setting STRING, lookup ARRAY<STRING>, idx INT)", "STRING",
     f"CASE WHEN upper(trim(setting)) RLIKE '{_KEYWORDS}' THEN get(lookup, idx) ELSE setting END"),
    ("normalised_account(code STRING)", "STRING", "nullif(upper(trim(code)), '')"),
    ("opposite_side(dc STRING)", "STRING", "CASE WHEN dc = 'D' THEN 'C' ELSE 'D' END"),
    ("is_reversal(journal_type STRING)", "BOOLEAN", "try_cast(substring(journal_type, 2, 1) AS INT) % 2 = 1"),
    ("source_name(ds INT)", "STRING", f"CASE {_ROUTES} END"),
    ("voucher_number(journal_type STRING, day DATE, seq BIGINT)", "STRING",
     f"concat(journal_type, date_format(day, 'yyMMdd'), lpad(cast(seq AS STRING), {VOUCHER_SEQUENCE_DIGITS}, '0'))"),
    ("voucher_description(description STRING, day DATE, seq BIGINT)", "STRING",
     f"substring(concat(description, ' ', cast(day AS STRING), '/', lpad(cast(seq AS STRING), {VOUCHER_SEQUENCE_DIGITS}, '0')), 1, 50)"),
    ("je_number(day DATE, source_rowid STRING)", "STRING", "concat('JE-', date_format(day, 'yyyyMM'), '-', source_rowid)"),
    ("location_or_default(code STRING, known STRING)", "STRING", f"CASE WHEN known IS NOT NULL THEN code ELSE '{DEFAULT_LOCATION_CODE}' END"),
    ("line_amount(setting_amount DECIMAL(20,2), amounts ARRAY<DECIMAL(24,5)>, idx INT)", "DECIMAL(20,2)",
     "CASE WHEN setting_amount > 0 THEN setting_amount ELSE cast(round(get(amounts, idx), 2) AS DECIMAL(20,2)) END"),
    ("base_amount(amount DECIMAL(20,2), rate DECIMAL(20,6))", "DECIMAL(20,2)", "cast(round(amount * rate, 2) AS DECIMAL(20,2))"),
    ("clean_reference(body STRING)", "STRING", "substring(replace(body, '.', ''), 1, 15)"),
]

_CODES = ", ".join(f"t{i}_code STRING" for i in range(1, 11))
_LINE = f"journal_line_number INT, process_line_number INT, account_code STRING, d_c_marker STRING, data_idx INT, account_flag INT, {_CODES}"
_FIELDS = ", ".join(f"r.{part.split()[0]}" for part in _LINE.split(", "))
#: Places of a posted line's values among its 57 fields, as published.
_POSTED = {"journal_line_number": 3, "account_code": 7, "d_c_marker": 13, "transaction_amount": 10} | {f"t{i}_code": 16 + i for i in range(1, 11)}


def _field(name: str) -> str:
    return f"get(l.fields, {_POSTED[name]})"


def _tables(settings: str | None, posted: str | None, journals: str | None, vouchers: str | None, ledger: str | None):
    """(signature, columns, body) of the table functions over the tables at hand."""
    if settings:
        yield (
            "setting_lines(of_type STRING)", _LINE,
            f"SELECT {_FIELDS} FROM (SELECT explode(from_json(journal_set, 'row ARRAY<STRUCT<{_LINE.replace(' ', ': ').replace(',:', ',')}>>').row) AS r"
            f" FROM {settings} WHERE journal_type = setting_lines.of_type)",
        )
    if settings and posted:
        codes = ", ".join(f"{_field(f't{i}_code')} AS t{i}_code" for i in range(1, 11))
        yield (
            "reversal_lines(of_type STRING, of_journal STRING)",
            _LINE.replace("account_flag INT,", "account_flag INT, transaction_amount DECIMAL(20,2),"),
            f"SELECT cast({_field('journal_line_number')} AS INT), s.process_line_number, {_field('account_code')}, opposite_side({_field('d_c_marker')}),"
            f" cast({_field('journal_line_number')} AS INT) - 1, s.account_flag, cast({_field('transaction_amount')} AS DECIMAL(20,2)), {codes}"
            f" FROM {posted} l LEFT JOIN setting_lines(reversal_lines.of_type) s ON cast({_field('journal_line_number')} AS INT) = s.journal_line_number"
            " WHERE l.journal_id = reversal_lines.of_journal AND is_reversal(reversal_lines.of_type)",
        )
    if journals and vouchers and ledger:
        count = "SELECT '{n}', cast(count(*) AS DECIMAL(24,6)), 'count' FROM {t} WHERE {c} = processing_metrics.of_day"
        yield (
            "processing_metrics(of_day DATE)", "metric_name STRING, metric_value DECIMAL(24,6), metric_unit STRING",
            f"SELECT 'avg_processing_time', cast(avg(cast(timestampdiff(SECOND, cast(journal_date AS TIMESTAMP_NTZ), cast(created_date AS TIMESTAMP_NTZ)) AS DECIMAL(18,0))) AS DECIMAL(24,6)), 'seconds'"
            f" FROM {journals} WHERE journal_date = processing_metrics.of_day UNION ALL "
            + " UNION ALL ".join(
                count.format(n=n, t=t, c=c)
                for n, t, c in (("total_journals", journals, "journal_date"), ("total_vouchers", vouchers, "journal_date"), ("total_gl_entries", ledger, "trx_date"))
            ),
        )


def register(
    spark: SparkSession,
    settings: str | None = None,
    posted: str | None = None,
    journals: str | None = None,
    vouchers: str | None = None,
    ledger: str | None = None,
) -> list[str]:
    """Make the functions and return their names.

    ``settings`` has journal_type and journal_set (JSON with the lines under ``row``); ``posted`` has journal_id and the
    ``fields`` of each line; ``journals`` and ``vouchers`` have journal_date, journals created_date, ``ledger`` trx_date.
    """
    made = []
    for signature, type_, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {type_} RETURN {body}")
        made.append(signature.split("(")[0])
    for signature, columns, body in _tables(settings, posted, journals, vouchers, ledger):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE ({columns}) RETURN {body}")
        made.append(signature.split("(")[0])
    return made
