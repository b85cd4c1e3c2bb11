"""Audit events: changed fields, risk, compliance flags and hash chains."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.merkle import FANOUT, hash_levels, leaf_hash, proven_root
from ledgerloom.operators.numbering import number_rows
from ledgerloom.operators.sequences import with_previous

# Event types that raise the risk of an event.
HIGH_RISK_EVENTS = ["JOURNAL_DELETED", "JOURNAL_REVERSED", "PERIOD_CLOSED", "FRAUD_ALERT"]
APPROVING_ROLES = ["SUPERVISOR", "MANAGER"]
JUSTIFIED_EVENTS = ["JOURNAL_DELETED", "JOURNAL_MODIFIED"]
GENESIS = "0" * 64

SCORE = "decimal(4,1)"
CHAIN = ["entity_type", "entity_id"]
ORDER = ["event_timestamp", "event_id"]


def changed_fields(old: Column, new: Column) -> Column:
    """Sorted keys whose values differ between two string maps."""
    keys = F.array_union(
        F.coalesce(F.map_keys(old), F.array().cast("array<string>")),
        F.coalesce(F.map_keys(new), F.array().cast("array<string>")),
    )
    return F.array_sort(
        F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)))
    )


def _part(cond: Column, value: str) -> Column:
    return F.when(cond, F.lit(value).cast(SCORE)).otherwise(F.lit(0).cast(SCORE))


def risk_score(fixed: bool = False) -> Column:
    """Score 0..1 of an audit event (columns in scope).

    The published rule tests the million first, so ten millions never reach
    their own, higher weight; ``fixed=True`` tests the higher bound first.
    """
    hour, amount = F.hour("event_timestamp"), F.col("amount")
    if fixed:
        value = F.when(amount > 10_000_000, F.lit("0.5").cast(SCORE)).when(amount > 1_000_000, F.lit("0.3").cast(SCORE))
    else:
        value = F.when(amount > 1_000_000, F.lit("0.3").cast(SCORE))
    total = (
        _part((hour < 6) | (hour > 22), "0.2")
        + F.coalesce(value, F.lit(0).cast(SCORE))
        + _part(F.col("event_type").isin(HIGH_RISK_EVENTS), "0.4")
        - _part(F.col("authentication_method") != "password", "0.1")
    ).cast(SCORE)
    return F.least(F.greatest(total, F.lit(0).cast(SCORE)), F.lit(1).cast(SCORE))


def with_compliance(events: DataFrame, in_open_period: Column | None = None) -> DataFrame:
    """Adds compliance_flags, approval_required and violation.

    A rule that stops an event is a value in ``violation`` (the first one).
    """
    kind, amount = F.col("event_type"), F.col("amount")
    segregation = (kind == "JOURNAL_APPROVED") & ~F.coalesce(F.col("user_role").isin(APPROVING_ROLES), F.lit(False))
    closed = F.lit(False) if in_open_period is None else F.col("business_date").isNotNull() & ~in_open_period
    unjustified = kind.isin(JUSTIFIED_EVENTS) & (F.coalesce("justification", F.lit("")) == "")
    high = F.coalesce(amount > 1_000_000, F.lit(False))
    flags = F.array_compact(
        F.array(
            F.when(segregation, "SEGREGATION_VIOLATION"),
            F.when(high, "HIGH_VALUE_TRANSACTION"),
            F.when(closed, "CLOSED_PERIOD_MODIFICATION"),
            F.when(unjustified, "SOX_JUSTIFICATION_MISSING"),
        )
    )
    violation = (
        F.when(segregation, "SEGREGATION_VIOLATION")
        .when(closed, "CLOSED_PERIOD_MODIFICATION")
        .when(unjustified, "SOX_JUSTIFICATION_MISSING")
    )
    return (
        events.withColumn("compliance_flags", flags)
        .withColumn("approval_required", F.coalesce(amount > 100_000, F.lit(False)))
        .withColumn("violation", violation)
    )


def payload_digest(columns: list[str]) -> Column:
    """Digest of the canonical event text: JSON with sorted keys."""

    def sorted_map(name: str) -> Column:
        return F.map_from_entries(F.array_sort(F.map_entries(name))).alias(name)

    fields = {
        "context_user_id": F.col("user_id"),
        "entity_id": F.col("entity_id"),
        "entity_type": F.col("entity_type"),
        "event_id": F.col("event_id"),
        "event_timestamp": F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "event_type": F.col("event_type"),
    }
    for name in ("new_values", "old_values"):
        if name in columns:
            fields[name] = sorted_map(name)
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())])), 256)


def segment_seed(segment: Column) -> Column:
    """Previous hash of a segment's first event; the genesis for segment 0."""
    seed = F.sha2(F.concat_ws("#", *CHAIN, segment.cast("string")), 256)
    return F.when(segment == 0, F.lit(GENESIS)).otherwise(seed)


def month_segment(timestamp: str = "event_timestamp") -> Column:
    """Calendar month as a number, the rule by which chains are cut unless another is given."""
    return (F.year(timestamp) * 12 + F.month(timestamp) - 1).cast("bigint")


def chain_segments(events: DataFrame, segment: Column | None = None) -> DataFrame:
    """Events with their segment and, as chain_no, their place in it."""
    cut = events.withColumn("segment", month_segment() if segment is None else segment.cast("bigint"))
    return number_rows(cut, ORDER, keys=[*CHAIN, "segment"], column="chain_no")


def build_hash_chain(events: DataFrame, segment: Column | None = None) -> DataFrame:
    """(event_id, segment, chain_no, hash_previous, hash_current) per chain.

    Linking is serial, so the chain of an entity is cut by a rule on the event itself: its calendar month, or
    ``segment``. Each segment starts from a seed of its own, and ``segment_heads`` links them. ``F.lit(0)`` as
    segment gives one chain per entity from the genesis hash, at any length.
    """
    keys = [*CHAIN, "segment"]
    slim = chain_segments(events, segment).select(
        *keys, "chain_no", "event_id", payload_digest(events.columns).alias("digest"),
        segment_seed(F.col("segment")).alias("seed"),
    )
    placed = slim.repartition(*keys).sortWithinPartitions(*keys, "chain_no")

    def link(batches):
        import hashlib

        key, last = None, None
        for pdf in batches:
            previous, current = [], []
            heads = zip(pdf["entity_type"], pdf["entity_id"], pdf["segment"])
            for here, digest, seed in zip(heads, pdf["digest"], pdf["seed"]):
                if here != key:
                    key, last = here, seed
                previous.append(last)
                last = hashlib.sha256((digest + last).encode()).hexdigest()
                current.append(last)
            out = pdf[["entity_type", "entity_id", "segment", "chain_no", "event_id"]].copy()
            out["hash_previous"], out["hash_current"] = previous, current
            yield out

    return placed.mapInPandas(
        link,
        "entity_type string, entity_id string, segment bigint, chain_no bigint, event_id bigint,"
        " hash_previous string, hash_current string",
    )


def segment_heads(chain: DataFrame) -> DataFrame:
    """Last hash of every segment with a root over the heads of its chain."""
    heads = chain.groupBy(*CHAIN, "segment").agg(F.max_by("hash_current", "chain_no").alias("head"))
    # One head per calendar month of an entity (or per value of the segment rule).
    roots = heads.groupBy(*CHAIN).agg(
        F.sha2(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("segment", "head"))), lambda x: x["head"]), ""
            ),
            256,
        ).alias("root")
    )
    return heads.join(roots, CHAIN)


def chain_tree(chain: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Nodes of a hash tree per entity over the last hashes of its segments (``merkle.hash_levels``).

    Its root stands for the whole chain like that of ``segment_heads``, without a cell that holds all heads.
    """
    heads = chain.groupBy(*CHAIN, "segment").agg(F.max_by("hash_current", "chain_no").alias("head"))
    return hash_levels(heads, CHAIN, "segment", "head", fanout)


def verify_segments(events: DataFrame, proofs: DataFrame, published: DataFrame, segment: Column | None = None) -> DataFrame:
    """Segments of whole-segment slice ``events`` that don't lead to the published root of their entity.

    ``proofs`` are those of the segments the slice should hold, ``published`` the roots. No event, head or hash from
    outside the slice is read, and stored hashes are not trusted: a segment whose events were altered and linked
    again is found. SEGMENT_MISSING names one without events, SEGMENT_UNKNOWN one without proof.
    """
    chain = build_hash_chain(events, segment)
    heads = chain.groupBy(*CHAIN, F.col("segment").alias("name")).agg(F.max_by("hash_current", "chain_no").alias("head"))
    met = heads.join(proofs, [*CHAIN, "name"], "full").join(published.select(*CHAIN, "root"), CHAIN, "left")
    reached = proven_root(leaf_hash(F.col("name"), F.col("head")), F.col("proof"))
    error = (
        F.when(F.col("head").isNull(), "SEGMENT_MISSING")
        .when(F.col("proof").isNull() | F.col("root").isNull(), "SEGMENT_UNKNOWN")
        .when(reached != F.col("root"), "ROOT_MISMATCH")
    )
    return met.select(*CHAIN, F.col("name").alias("segment"), error.alias("error")).where("error IS NOT NULL")


def verify_hash_chain(events: DataFrame, sliced: bool = False) -> DataFrame:
    """Events whose link or content does not fit, with what was expected.

    ``events`` carry segment, hash_previous and hash_current. With ``sliced`` they are a range of dates: the first
    event of a segment that begins before the range has its predecessor outside and is checked for its content
    only. With chain_no, the place of an event in its segment, first events of segments are told apart and tested against
    the seed; without it none is.
    """
    linked = with_previous(events, ORDER, "hash_current", "_before", keys=[*CHAIN, "segment"])
    seed = segment_seed(F.col("segment"))
    if sliced and "chain_no" in events.columns:
        seed = F.when(F.col("chain_no") == 1, seed)
    elif sliced:
        seed = F.lit(None).cast("string")
    expected_link = F.coalesce("_before", seed)
    recomputed = F.sha2(F.concat(payload_digest(events.columns), F.col("hash_previous")), 256)
    broken = F.struct(
        F.lit("HASH_CHAIN_BROKEN").alias("error"), expected_link.alias("expected"), F.col("hash_previous").alias("actual")
    )
    mismatch = F.struct(
        F.lit("HASH_MISMATCH").alias("error"), recomputed.alias("expected"), F.col("hash_current").alias("actual")
    )
    errors = F.array_compact(
        F.array(
            F.when(expected_link != F.col("hash_previous"), broken),
            F.when(recomputed != F.col("hash_current"), mismatch),
        )
    )
    return linked.select("event_id", *CHAIN, F.explode_outer(errors).alias("e")).where(
        F.col("e").isNotNull()
    ).select("event_id", *CHAIN, "e.*")


def forensic_search(
    events: DataFrame,
    entity_id: str | None = None,
    user_id: int | None = None,
    event_type: str | None = None,
    start=None,
    end=None,
    ip_address: str | None = None,
) -> DataFrame:
    """Filtered events in report form, newest first."""
    tests = [
        (entity_id, lambda v: F.col("entity_id") == v),
        (user_id, lambda v: F.col("user_id") == v),
        (event_type, lambda v: F.col("event_type") == v),
        (start, lambda v: F.col("event_timestamp") >= F.lit(v)),
        (end, lambda v: F.col("event_timestamp") <= F.lit(v)),
        (ip_address, lambda v: F.col("ip_address") == v),
    ]
    for value, cond in tests:
        if value is not None:
            events = events.where(cond(value))
    extra = [c for c in ("changed_fields", "risk_score", "compliance_flags", "hash_current") if c in events.columns]
    return events.orderBy(F.desc("event_timestamp"), F.desc("event_id")).select(
        "event_id",
        "event_timestamp",
        "event_type",
        F.concat_ws(":", "entity_type", "entity_id").alias("entity"),
        F.concat(F.col("user_name"), F.lit(" ("), F.col("user_id").cast("string"), F.lit(")")).alias("user"),
        "ip_address",
        *extra,
    )


def audit_log(
    events: DataFrame, in_open_period: Column | None = None, fixed_risk: bool = False,
    segment: Column | None = None,
) -> DataFrame:
    """Events with changes, risk, flags and their place in the hash chain."""
    rich = with_compliance(events, in_open_period).withColumn("risk_score", risk_score(fixed_risk))
    if {"old_values", "new_values"} <= set(events.columns):
        rich = rich.withColumn("changed_fields", changed_fields(F.col("old_values"), F.col("new_values")))
    chain = build_hash_chain(events, segment).drop(*CHAIN)
    return rich.join(chain, "event_id")


def alerts(scored: DataFrame) -> DataFrame:
    """Events above risk 0.7 or carrying a stopping violation."""
    return scored.where((F.col("risk_score") > F.lit(Decimal("0.7"))) | F.col("violation").isNotNull())
