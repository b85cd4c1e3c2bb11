"""Template-driven posting: business transactions to journal entries.

A small catalogue (``CASE_ROWS``) is read once, its expressions are compiled to Spark columns, and routing plus line
expansion become one CASE and one explode over the transactions: no join and no shuffle.

A larger one stays a table. Matches are indexed by what they ask for exactly (type, product, channel) and by
the months and amount classes of short intervals; a transaction probes the few kinds of keys that occur, exact tests
follow, and the first match by priority, specific before wildcard, is found by partial aggregation. Only distinct
expressions are compiled: a transaction evaluates each once, and the lines of its template name them by number.
Both ways give the same rows.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.functions import codes as C
from ledgerloom.functions.expressions import compile_expression
from ledgerloom.scratch import cut

AMOUNT = "decimal(20,6)"
CASE_ROWS = 2_000  #: rows of each catalogue table up to which it is compiled into a CASE
SPAN = 24  #: months, or amount classes, up to which an interval is listed bin by bin


@dataclass(frozen=True)
class Catalogue:
    templates: list[Row]
    matches: list[Row]
    lines: dict[tuple[str, str], list[Row]]
    conditions: dict[tuple[str, str, int], list[str]]
    controls: dict[tuple[str, str], Row]


@dataclass(frozen=True)
class TableCatalogue:
    """A catalogue too large to be compiled into one expression."""

    templates: DataFrame
    matches: DataFrame
    lines: DataFrame
    conditions: DataFrame
    controls: DataFrame


def load_catalogue(
    templates: DataFrame,
    matches: DataFrame,
    lines: DataFrame,
    conditions: DataFrame,
    controls: DataFrame,
    case_rows: int = CASE_ROWS,
) -> Catalogue | TableCatalogue:
    """The catalogue as rows if none of its tables has more than ``case_rows``, else as tables."""
    tables = (templates, matches, lines, conditions, controls)
    rows = [df.limit(case_rows + 1).collect() for df in tables]
    if any(len(r) > case_rows for r in rows):
        return TableCatalogue(*tables)
    by_template: dict[tuple[str, str], list[Row]] = defaultdict(list)
    for r in sorted(rows[2], key=lambda r: r.line_no):
        by_template[r.template_code, r.template_version].append(r)
    conds: dict[tuple[str, str, int], list[str]] = defaultdict(list)
    for r in sorted(rows[3], key=lambda r: r.cond_name):
        conds[r.template_code, r.template_version, r.line_no].append(r.cond_expr)
    ctrl = {(r.template_code, r.template_version): r for r in rows[4]}
    return Catalogue(rows[0], rows[1], by_template, conds, ctrl)


def _routing_order(catalogue: Catalogue) -> list[tuple[Row, Row]]:
    """Matches of active templates: by priority, specific before wildcard."""
    active = {(t.template_code, t.template_version): t for t in catalogue.templates if t.status == "ACTIVE"}
    pairs = [
        (m, active[m.template_code, m.template_version])
        for m in catalogue.matches
        if (m.template_code, m.template_version) in active
    ]
    return sorted(
        pairs, key=lambda p: (p[0].priority, p[0].product_code is None, p[0].channel is None, p[0].match_id)
    )


def _matches(match: Row, template: Row, columns: list[str]) -> Column:
    day, gross = F.col("bank_value_date"), F.col("gross_amount")
    cond = (
        (F.col("txn_type") == template.txn_type)
        & (F.lit(template.effective_date) <= day)
        & (day < F.lit(template.expiry_date))
    )
    if match.product_code is not None:
        cond = cond & (F.col("product_code") == match.product_code)
    if match.channel is not None:
        cond = cond & (F.col("channel") == match.channel)
    if match.min_amount is not None:
        cond = cond & (gross >= F.lit(match.min_amount))
    if match.max_amount is not None:
        cond = cond & (gross <= F.lit(match.max_amount))
    if match.condition_expr:
        cond = cond & compile_expression(match.condition_expr, columns)
    return cond


def resolve_templates(txn: DataFrame, catalogue: Catalogue | TableCatalogue) -> DataFrame:
    """Adds match_id, template_code and template_version (NULL when none fits)."""
    if isinstance(catalogue, TableCatalogue):
        return routed_by_index(txn, catalogue)
    return _routed(txn, catalogue).drop("_no")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def _size_class(amount: Column) -> Column:
    """Sixteen classes for a factor of ten; never falls as the amount rises."""
    return F.when(amount > 0, F.floor(F.log10(amount.cast("double")) * 16)).otherwise(F.lit(-1_000)).cast("int")


def _numbered(texts: DataFrame) -> dict[tuple, int]:
    """A number for each distinct row of expression texts, in the order of the numbers."""
    rows = sorted(texts.distinct().collect(), key=repr)
    return {tuple(tuple(x) if isinstance(x, list) else x for x in r): i for i, r in enumerate(rows)}


PROBE = ["txn_type", "_product", "_channel", "_month", "_class"]


def match_index(templates: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches of active templates under the keys by which transactions find them.

    A missing product or channel is the key part '*' (the others begin with '='). An interval of days or amounts that
    is open or longer than ``SPAN`` bins has the bin -1 for all.
    """
    active = templates.where("status = 'ACTIVE'").select("template_code", "template_version", "txn_type", "je_type", "effective_date", "expiry_date")
    rows = matches.join(active, ["template_code", "template_version"])
    wild = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("*"))

    def bins(low: Column, high: Column) -> Column:
        every = F.array(F.lit(-1))
        return F.when((high - low).between(0, SPAN - 1), F.sequence(low, high)).when(high < low, F.array().cast("array<int>")).otherwise(every)

    month = bins(_month(F.col("effective_date")), _month(F.date_sub("expiry_date", 1)))
    size = F.coalesce(bins(_size_class(F.col("min_amount")), _size_class(F.col("max_amount"))), F.array(F.lit(-1)))
    closed = F.col("min_amount").isNotNull() & F.col("max_amount").isNotNull()
    return (
        rows.withColumns({"_product": wild("product_code"), "_channel": wild("channel"), "_month": F.explode(month)})
        .withColumn("_class", F.explode(F.when(closed, size).otherwise(F.array(F.lit(-1)))))
        .withColumn("_order", F.struct("priority", F.col("product_code").isNull().alias("p"), F.col("channel").isNull().alias("c"), "match_id"))
        .drop("product_code", "channel", "priority")
    )


def routed_by_index(txn: DataFrame, catalogue: TableCatalogue) -> DataFrame:
    """``txn`` with match_id, template_code, template_version and je_type by joins with the index of matches.

    Transactions and index are written: the first for their row numbers, the second to be read by its size.
    """
    index = cut(match_index(catalogue.templates, catalogue.matches), "match-index")
    numbers = _numbered(index.where("coalesce(condition_expr, '') <> ''").select("condition_expr"))
    columns = txn.columns
    rows = cut(txn.withColumn("_row", F.monotonically_increasing_id()), "routed-rows")
    # At most 16 kinds of keys: product, channel, month and amount class given or not.
    marks = [(F.col("_product") != "*"), (F.col("_channel") != "*"), (F.col("_month") != -1), (F.col("_class") != -1)]
    kinds = index.select(*[m.cast("int").alias(f"k{i}") for i, m in enumerate(marks)]).distinct().collect()
    day, gross = F.col("bank_value_date"), F.col("gross_amount")
    given = [F.concat(F.lit("="), F.col("product_code")), F.concat(F.lit("="), F.col("channel")), _month(day), _size_class(gross)]
    absent = [F.lit("*"), F.lit("*"), F.lit(-1), F.lit(-1)]
    keys = [F.struct(*[(given if k[i] else absent)[i].alias(PROBE[i + 1]) for i in range(4)]) for k in kinds]
    # Conditions may ask for any column; without them only the keys travel.
    asked = [F.col(c) for c in columns if c != "txn_type"] if numbers else [day, gross]
    slim = rows.select("_row", "txn_type", *asked, F.explode(F.array(*keys)).alias("_k")).select("*", "_k.*").drop("_k")
    found = slim.join(index, PROBE).where(
        (F.col("effective_date") <= day)
        & (day < F.col("expiry_date"))
        & (F.col("min_amount").isNull() | (gross >= F.col("min_amount")))
        & (F.col("max_amount").isNull() | (gross <= F.col("max_amount")))
    )
    if numbers:
        text = F.coalesce("condition_expr", F.lit(""))
        passed = F.when(text == "", F.lit(True))
        for (expression,) in numbers:
            passed = passed.when(text == expression, compile_expression(expression, columns))
        found = found.where(passed)
    value = F.struct("match_id", "template_code", "template_version", "je_type")
    best = found.groupBy("_row").agg(F.min_by(value, "_order").alias("_t"))
    return rows.join(best, "_row", "left").select(*columns, "_t.match_id", "_t.template_code", "_t.template_version", "_t.je_type")


def _template_keys(catalogue: Catalogue) -> list[tuple[str, str]]:
    """Routable templates; the position is the number carried by routed rows."""
    return sorted({(t.template_code, t.template_version) for _, t in _routing_order(catalogue)})


def _routed(txn: DataFrame, catalogue: Catalogue) -> DataFrame:
    """The routing CASE sits below a one-element explode, so the optimizer
    cannot copy it into every later expression that asks for the template."""
    numbers = {key: i for i, key in enumerate(_template_keys(catalogue))}
    chosen = None
    for m, t in _routing_order(catalogue):
        value = F.struct(
            F.lit(m.match_id).alias("match_id"),
            F.lit(t.template_code).alias("template_code"),
            F.lit(t.template_version).alias("template_version"),
            F.lit(t.je_type).alias("je_type"),
            F.lit(numbers[t.template_code, t.template_version]).alias("_no"),
        )
        cond = _matches(m, t, txn.columns)
        chosen = F.when(cond, value) if chosen is None else chosen.when(cond, value)
    if chosen is None:
        raise ValueError("the catalogue has no active match")
    return txn.withColumn("_t", F.explode_outer(F.array(chosen))).select(
        *txn.columns, "_t.match_id", "_t.template_code", "_t.template_version", "_t.je_type", "_t._no"
    )


class Expanded(NamedTuple):
    headers: DataFrame
    lines: DataFrame
    unbalanced: DataFrame
    unmatched: DataFrame


def _template_entries(catalogue: Catalogue, key: tuple[str, str], columns: list[str]) -> Column:
    entries = []
    for r in catalogue.lines.get(key, []):
        if not r.is_active:
            continue
        amount = F.round(compile_expression(r.amount_expr, columns), r.amount_round).cast(AMOUNT)
        for text in catalogue.conditions.get((*key, r.line_no), []):
            amount = F.when(compile_expression(text, columns), amount)
        entries.append(
            F.struct(
                F.lit(r.line_no).alias("line_no"),
                F.lit(r.side).alias("side"),
                F.lit(r.account_code).alias("account_code"),
                F.lit(r.fund_code).alias("fund"),
                amount.alias("amount"),
            )
        )
    return F.array(*entries)


def _difference(catalogue: Catalogue, key: tuple[str, str], columns: list[str]) -> Column:
    """Debit minus credit of one transaction, from plain columns."""
    total = F.lit(Decimal("0")).cast(AMOUNT)
    for r in catalogue.lines.get(key, []):
        if not r.is_active:
            continue
        amount = F.round(compile_expression(r.amount_expr, columns), r.amount_round).cast(AMOUNT)
        for text in catalogue.conditions.get((*key, r.line_no), []):
            amount = F.when(compile_expression(text, columns), amount)
        amount = F.coalesce(amount, F.lit(Decimal("0")).cast(AMOUNT))
        total = (total + amount if r.side == "DR" else total - amount).cast(AMOUNT)
    return total


def expand_transactions(
    txn: DataFrame, catalogue: Catalogue | TableCatalogue, run_id: str = "run", created_by: str = "engine"
) -> Expanded:
    """Headers and lines; zero lines dropped; templates set to AUTO_ADJUST get
    one balancing line. Entries out of balance otherwise are in ``unbalanced``."""
    columns = txn.columns
    if isinstance(catalogue, TableCatalogue):
        base, unmatched = _by_tables(txn, catalogue)
        return _expanded(base, F.col("_entries"), F.col("_out"), unmatched, run_id, created_by)
    routed = _routed(txn, catalogue)
    matched = routed.where(F.col("_no").isNotNull())
    entries = diff = None
    for number, key in enumerate(_template_keys(catalogue)):
        hit = F.col("_no") == number
        delta = _difference(catalogue, key, columns)
        control = catalogue.controls.get(key)
        rows = _template_entries(catalogue, key, columns)
        if control is not None and control.balancing_mode == "AUTO_ADJUST":
            last = max(r.line_no for r in catalogue.lines[key])
            rows = F.concat(
                rows,
                F.array(
                    F.struct(
                        F.lit(last + 1).alias("line_no"),
                        F.when(delta > 0, "CR").otherwise("DR").alias("side"),
                        F.lit(control.balancing_account).alias("account_code"),
                        F.lit(control.balancing_fund).alias("fund"),
                        F.abs(delta).cast(AMOUNT).alias("amount"),
                    )
                ),
            )
            left = F.lit(False)
        else:
            required = control.require_balanced if control is not None else True
            tolerance = control.tolerance_amount if control is not None else Decimal("0.01")
            left = (F.abs(delta) > F.lit(tolerance)) if required else F.lit(False)
        out = F.struct(delta.alias("difference"), left.alias("unbalanced"))
        entries = F.when(hit, rows) if entries is None else entries.when(hit, rows)
        diff = F.when(hit, out) if diff is None else diff.when(hit, out)

    return _expanded(matched, entries, diff, routed.where(F.col("_no").isNull()).select(*columns), run_id, created_by)


def _by_tables(txn: DataFrame, catalogue: TableCatalogue) -> tuple[DataFrame, DataFrame]:
    """Matched transactions with their entries and difference, and those without a template.

    Each distinct (expression, rounding) and each distinct set of conditions is one element of two arrays of the
    transaction; the lines of a template, one row per template, point into them.
    """
    key = ["template_code", "template_version"]
    sets = catalogue.conditions.groupBy(*key, "line_no").agg(F.array_sort(F.collect_set("cond_expr")).alias("conds"))
    lines = catalogue.lines.where("is_active").join(sets, [*key, "line_no"], "left")
    lines = cut(lines.withColumn("conds", F.coalesce("conds", F.array().cast("array<string>"))), "template-lines")
    amounts = _numbered(lines.select("amount_expr", "amount_round"))
    conds = {tuple(t): i for (t,), i in _numbered(lines.select("conds")).items()}
    spark, columns = txn.sparkSession, txn.columns
    amount_no = spark.createDataFrame([(*k, i) for k, i in amounts.items()], "amount_expr string, amount_round int, _amount int")
    cond_no = spark.createDataFrame([(list(k), i) for k, i in conds.items()], "conds array<string>, _cond int")
    numbered = lines.withColumn("amount_round", F.col("amount_round").cast("int")).join(amount_no, ["amount_expr", "amount_round"]).join(cond_no, ["conds"])
    item = F.struct("line_no", "side", "account_code", F.col("fund_code").alias("fund"), "_amount", "_cond")
    by_template = numbered.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("_lines"))
    last = catalogue.lines.groupBy(*key).agg(F.max("line_no").alias("_last"))
    table = catalogue.controls.join(last.join(by_template, key, "left"), key, "right").withColumn("_control", F.col("balancing_mode").isNotNull())
    table = cut(table, "template-table")

    routed = routed_by_index(txn, catalogue)
    met = routed.where(F.col("match_id").isNotNull()).join(table, key, "left")
    # An expression is evaluated only where the template has it: it might fail elsewhere.
    uses = lambda c, i: F.exists("_lines", lambda x: x[c] == i)
    values = [F.when(uses("_amount", i), F.round(compile_expression(t, columns), n).cast(AMOUNT)) for (t, n), i in amounts.items()]
    true = F.lit(True)
    tests = [F.when(uses("_cond", i), functools.reduce(lambda a, t: a & compile_expression(t, columns), texts, true)) for texts, i in conds.items()]
    met = met.withColumn("_values", F.array(*values).cast(f"array<{AMOUNT}>")).withColumn("_tests", F.array(*tests).cast("array<boolean>"))

    def entry(x):
        amount = F.when(F.col("_tests")[x["_cond"]], F.col("_values")[x["_amount"]])
        return F.struct(x["line_no"].alias("line_no"), x["side"].alias("side"), x["account_code"].alias("account_code"), x["fund"].alias("fund"), amount.alias("amount"))

    zero = F.lit(Decimal("0")).cast(AMOUNT)
    signed = lambda a, x: (a + F.when(x["side"] == "DR", 1).otherwise(-1) * F.coalesce(x["amount"], zero)).cast(AMOUNT)
    empty = F.array().cast("array<struct<line_no:int,side:string,account_code:string,fund:string,amount:decimal(20,6)>>")
    met = met.withColumn("_plain", F.coalesce(F.transform("_lines", entry), empty)).withColumn("_delta", F.aggregate("_plain", zero, signed))
    adjust = F.coalesce(F.col("balancing_mode") == "AUTO_ADJUST", F.lit(False))
    side = F.when(F.col("_delta") > 0, "CR").otherwise("DR")
    extra = F.struct((F.col("_last") + 1).alias("line_no"), side.alias("side"), F.col("balancing_account").alias("account_code"), F.col("balancing_fund").alias("fund"), F.abs("_delta").cast(AMOUNT).alias("amount"))
    entries = F.when(adjust, F.concat("_plain", F.array(extra))).otherwise(F.col("_plain"))
    required = F.when(F.col("_control"), F.col("require_balanced")).otherwise(F.lit(True))
    tolerance = F.when(F.col("_control"), F.col("tolerance_amount")).otherwise(F.lit(Decimal("0.01")))
    left = ~adjust & required & (F.abs("_delta") > tolerance)
    out = F.struct(F.col("_delta").alias("difference"), left.alias("unbalanced"))
    base = met.select(*columns, "match_id", *key, "je_type", entries.alias("_entries"), out.alias("_out"))
    return base, routed.where(F.col("match_id").isNull()).select(*columns)


def _expanded(matched: DataFrame, entries: Column, diff: Column, unmatched: DataFrame, run_id: str, created_by: str) -> Expanded:
    base = matched.withColumn("je_number", C.je_number(F.col("bank_value_date"), F.col("source_rowid"))).withColumn(
        "je_date", F.col("bank_value_date")
    ).withColumn("je_id", C.stable_key(F.col("je_number")))  # below the explode of the lines: one digest a transaction
    stamp = [F.lit(run_id).alias("run_id"), F.lit(created_by).alias("created_by")]
    headers = base.select(
        "je_id", "je_number", "je_date", "je_type", "source_rowid",
        "template_code", "template_version", *stamp,
    )
    lines = (
        base.withColumn("e", F.explode_outer(entries))
        .where(F.col("e.amount") != 0)
        .select(
            "je_id", "je_number", "e.*", "product_code", "channel",
            "je_date", "template_code", "template_version", stamp[0],
        )
    )
    unbalanced = (
        base.withColumn("d", diff)
        .where("d.unbalanced")
        .select("je_number", "template_code", "template_version", "d.difference")
    )
    return Expanded(headers, lines, unbalanced, unmatched)
