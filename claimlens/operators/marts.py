"""The wide reporting table and its precomputed trackers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.cleaning import keep_first
from claimlens.operators.ordered import (
    ascending,
    attach_lookup,
    rank_in_group,
    running_sum_in_ranges,
    stored_by_column,
    stored_lookup,
    tagged_ranges,
    with_tile,
)
from claimlens.operators.summary import adjuster_tracker, contractor_tracker, suspects, with_tier
from claimlens.operators.windows import adjuster_payouts


def first_claim_keys(df: DataFrame) -> DataFrame:
    """Property and date of the first suspect claim of each manager."""
    claims = suspects(df).select("MANAGER_ID", "INCIDENT_DATE", "PROPERTY_ID")
    first = keep_first(claims, ["INCIDENT_DATE", "PROPERTY_ID"], ["MANAGER_ID"])
    return first.select("PROPERTY_ID", "INCIDENT_DATE").distinct()


def reporting_mart(
    portfolio: DataFrame,
    adjusters: DataFrame | None = None,
    contractors: DataFrame | None = None,
    ranges: int | None = None,
    measures: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The portfolio with tier, decile, running damage, ranks, first-claim mark and both trackers.

    ``portfolio`` is computed and stored once, and every part below reads the columns it needs from that copy. Claims
    equal in property and date are told apart by their stored row number. The rows find their range of country and
    date in place and move once, for the running sum; the decile needs no movement. The trackers may be given
    precomputed. Each joined side is stored, so that Spark decides by its bytes how to join it. ``measures`` adds columns
    that follow from the others of a row; they are computed where they are read and neither stored nor moved.

    The first-claim mark joins on property and date, which keeps one output row per input row; a join on the
    property alone would pair every suspect claim of a property with every claim of it.
    """
    measures = measures or (lambda df: df)
    order = ["INCIDENT_DATE", "PROPERTY_ID", "_row"]
    kept = stored_by_column(portfolio.withColumn("_row", F.monotonically_increasing_id()))
    rows = measures(kept)
    # Of the measures the running sum needs one.
    summed = "TOTAL_FINANCIAL_DAMAGE_USD"
    moved = rows.select(*dict.fromkeys([*kept.columns, summed]))
    base = tagged_ranges(moved, ["COUNTRY_CODE", *order], ranges, is_stored=True)
    wide = running_sum_in_ranges(base, {summed: "running_total_damage_usd"}, ascending(*order), ["COUNTRY_CODE"])
    wide = wide.select(*kept.columns, "running_total_damage_usd")
    by_payout = ["PAYOUT_AUTHORIZED", "PROPERTY_ID", "INCIDENT_DATE", "_row"]
    wide = with_tile(wide, by_payout, 10, "payout_decile", source=rows, is_stored=True)

    keys = ["COUNTRY_CODE", "ADJUSTER_ID"]
    ranks = rank_in_group(adjuster_payouts(rows), "fake_payout_total", "adjuster_rank", ["COUNTRY_CODE"], ranges)
    adjusters = adjuster_tracker(rows) if adjusters is None else adjusters
    contractors = contractor_tracker(rows) if contractors is None else contractors

    first = first_claim_keys(rows).withColumn("first_corrupt_claim", F.lit(1))
    wide = attach_lookup(wide, first, ["PROPERTY_ID", "INCIDENT_DATE"])
    by_adjuster = adjusters.select(
        F.col("adjuster_id").alias("ADJUSTER_ID"),
        "total_bribes",
        "unique_shell_companies",
        F.col("total_authorized_payouts").alias("adjuster_total_authorized_payouts"),
    )
    # Ranks and tracker meet over the pairs of country and adjuster, so that the wide rows move once for both. Missing keys
    # match nothing here, as in an ordinary equi-join.
    pairs = rows.select(*keys).distinct().join(stored_lookup(ranks), keys, "left")
    wide = attach_lookup(wide, pairs.join(stored_lookup(by_adjuster), "ADJUSTER_ID", "left"), keys)
    wide = measures(wide).transform(with_tier)
    by_contractor = contractors.select(
        F.col("contractor").alias("DECODED_CONTRACTOR"),
        F.col("total_incidents").alias("contractor_total_incidents"),
        F.col("total_payout_stolen").alias("contractor_total_payout_stolen"),
        F.col("avg_premium_spike").alias("contractor_avg_premium_spike"),
    )
    wide = wide.join(stored_lookup(by_contractor), "DECODED_CONTRACTOR", "left")
    derived = [
        "valuation_tier",
        "payout_decile",
        "running_total_damage_usd",
        "fake_payout_total",
        "adjuster_rank",
        F.coalesce("first_corrupt_claim", F.lit(0)).alias("first_corrupt_claim"),
        "total_bribes",
        "unique_shell_companies",
        "adjuster_total_authorized_payouts",
        "contractor_total_incidents",
        "contractor_total_payout_stolen",
        "contractor_avg_premium_spike",
    ]
    return wide.select(*[c for c in rows.columns if c != "_row"], *derived)


def mart_preview(mart: DataFrame, limit: int = 1000) -> DataFrame:
    """The first rows of the mart by property and date."""
    return mart.orderBy(*ascending("PROPERTY_ID", "INCIDENT_DATE")).limit(limit)


def refresh_trackers(df: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Write both trackers as Parquet and return them as read back, for :func:`reporting_mart`."""
    adjuster_tracker(df).write.mode("overwrite").parquet(f"{folder}/adjuster_tracker")
    contractor_tracker(df).write.mode("overwrite").parquet(f"{folder}/contractor_tracker")
    return load_trackers(df, folder)


def load_trackers(df: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    read = df.sparkSession.read
    return read.parquet(f"{folder}/adjuster_tracker"), read.parquet(f"{folder}/contractor_tracker")
