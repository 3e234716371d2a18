"""Order-dependent screening: sequences of claims, ranks, running totals and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.parsing import epoch_micros
from claimlens.operators.cleaning import keep_first
from claimlens.operators.ordered import (
    ascending,
    attach_lookup,
    next_in_group,
    rank_in_group,
    running_sum,
    running_sum_of_rows,
    stored,
    with_tile,
)
from claimlens.operators.summary import daily_spike, suspects

DAY_MICROS = 86_400_000_000


def repeat_claims(df: DataFrame, ties: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Claims whose manager's next claim went to the same adjuster, with that next claim.

    ``ties`` orders claims equal in every column shown, so that copies spread over several ranges.
    """
    shown = ["PROPERTY_ID", "INCIDENT_DATE", "MANAGER_ID", "ADJUSTER_ID", "PAYOUT_AUTHORIZED"]
    following = {
        "PROPERTY_ID": "next_property_id",
        "INCIDENT_DATE": "next_incident_date",
        "ADJUSTER_ID": "next_adjuster_id",
        "PAYOUT_AUTHORIZED": "next_payout_authorized",
    }
    order = ["INCIDENT_DATE", "PROPERTY_ID", "ADJUSTER_ID", "PAYOUT_AUTHORIZED", *ties]
    led = next_in_group(df.select(*shown, *ties), following, ["MANAGER_ID"], order, ranges)
    repeated = led.filter(F.col("ADJUSTER_ID") == F.col("next_adjuster_id")).drop(*ties)
    return repeated.orderBy(*ascending("MANAGER_ID", "INCIDENT_DATE", "PROPERTY_ID"))


def payout_deciles(df: DataFrame, ties: Sequence[str], is_stored: bool = False) -> DataFrame:
    """Payout decile of every claim; ``ties`` orders claims of equal payout. ``is_stored`` is that of ``tile_limits``."""
    return with_tile(df, ["PAYOUT_AUTHORIZED", *ties], 10, "payout_decile", is_stored=is_stored)


def running_damage(df: DataFrame, ties: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Damage accumulated within each country in order of date and property."""
    damage = {"TOTAL_FINANCIAL_DAMAGE_USD": "running_total_damage_usd"}
    return running_sum_of_rows(df, damage, ["INCIDENT_DATE", "PROPERTY_ID", *ties], ["COUNTRY_CODE"], ranges)


def adjuster_payouts(df: DataFrame) -> DataFrame:
    """Suspect payout of each adjuster in each country."""
    return suspects(df).groupBy("COUNTRY_CODE", "ADJUSTER_ID").agg(F.sum("PAYOUT_AUTHORIZED").alias("fake_payout_total"))


def rank_adjusters(df: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adjusters of each country ranked by their suspect payout."""
    totals = adjuster_payouts(df)
    ranked = rank_in_group(totals, "fake_payout_total", "adjuster_rank", ["COUNTRY_CODE"], ranges)
    return ranked.orderBy(*ascending("COUNTRY_CODE", "adjuster_rank", "ADJUSTER_ID"))


def first_suspect_claims(df: DataFrame) -> DataFrame:
    """Earliest suspect claim of each manager."""
    claim = suspects(df).select(
        "MANAGER_ID", "PROPERTY_ID", "INCIDENT_DATE", F.col("PAYOUT_AUTHORIZED").alias("payout_authorized")
    )
    first = keep_first(claim, ["INCIDENT_DATE", "PROPERTY_ID", "payout_authorized"], ["MANAGER_ID"])
    return first.orderBy(*ascending("MANAGER_ID"))


def rolling_mean(points: DataFrame, time: str, value: str, out: str, days: int = 30, ranges: int | None = None) -> DataFrame:
    """Mean of the points in the ``days`` up to and including each point, the far end excluded.

    Every value enters a running sum at its time and leaves it a window later. The sums are of exact decimals, so
    what left leaves no trace, and the work grows with the points and not with those in a window.
    """
    span = days * DAY_MICROS
    timed = points.withColumn("_t", epoch_micros(F.col(time)))
    # A double as an exact pair: a part of twelve decimals and what it leaves, in units of 1e-24.
    amount = F.col(value).cast("double")
    coarse = amount.cast("decimal(38,12)")
    rest = ((amount - coarse.cast("double")) * 1e24).cast("decimal(38,0)")
    known = timed.filter(amount.isNotNull()).groupBy("_t").agg(
        F.sum(coarse).cast("decimal(38,12)").alias("_a"), F.sum(rest).cast("decimal(38,0)").alias("_b"), F.count(F.lit(1)).alias("_k")
    )
    here = F.struct(F.col("_t").alias("_at"), "_a", "_b", "_k")
    gone = F.struct((F.col("_t") + span).alias("_at"), (-F.col("_a")).alias("_a"), (-F.col("_b")).alias("_b"), (-F.col("_k")).alias("_k"))
    asked = timed.select(F.col("_t").alias("_at"), F.lit(0).cast("decimal(38,12)").alias("_a"), F.lit(0).cast("decimal(38,0)").alias("_b"), F.lit(0).cast("bigint").alias("_k")).distinct()
    steps = known.select(F.inline(F.array(here, gone))).unionByName(asked).groupBy("_at").agg(
        F.sum("_a").cast("decimal(38,12)").alias("_a"), F.sum("_b").cast("decimal(38,0)").alias("_b"), F.sum("_k").alias("_k")
    )
    summed = running_sum(steps, {"_a": "_ra", "_b": "_rb", "_k": "_rk"}, [F.col("_at").asc()], ranges=ranges)
    total = F.col("_ra").cast("double") + F.col("_rb").cast("double") / 1e24
    means = summed.select(F.col("_at").alias("_t"), F.try_divide(total, F.col("_rk")).alias(out))
    return attach_lookup(timed, means, ["_t"]).drop("_t")


def spike_trend(df: DataFrame, days: int = 30) -> DataFrame:
    """Daily mean premium spike and its 30-day rolling mean."""
    return rolling_mean(daily_spike(df), "INCIDENT_DATE", "mean_spike", "rolling_mean_spike", days)


def cumulative_damage(df: DataFrame, ranges: int | None = None) -> DataFrame:
    """Managers by total damage with running damage, running share, place and number of managers.

    Claims without a manager count as one manager.
    """
    totals = df.groupBy("MANAGER_ID").agg(
        F.coalesce(F.sum("TOTAL_FINANCIAL_DAMAGE_USD"), F.lit(0)).alias("total_damage_usd"),
        F.lit(1).alias("one"),
    )
    order = [F.col("total_damage_usd").desc(), F.col("MANAGER_ID").asc_nulls_last()]
    kept = stored(totals)
    whole = kept.agg(
        F.struct(F.sum("total_damage_usd").cast("double").alias("damage"), F.sum("one").alias("managers"))
    ).scalar()
    sums = {"total_damage_usd": "cumulative_damage", "one": "place"}
    placed = running_sum(kept, sums, order, ranges=ranges)
    share = F.col("cumulative_damage").cast("double") / F.col("whole.damage")
    return placed.withColumn("whole", whole).select(
        "MANAGER_ID",
        "total_damage_usd",
        "cumulative_damage",
        F.when(F.col("whole.damage") == 0, 0.0).otherwise(share).alias("cumulative_share"),
        "place",
        F.col("whole.managers").alias("managers"),
    )


def pareto_managers(df: DataFrame, percent: int = 20, ranges: int | None = None) -> DataFrame:
    """The managers that make up the top ``percent`` by damage, at least one."""
    kept = F.greatest(F.lit(1), F.ceil(F.col("managers") * percent / 100))
    top = cumulative_damage(df, ranges).filter(F.col("place") <= kept).drop("place", "managers")
    return top.orderBy(F.col("total_damage_usd").desc(), F.col("MANAGER_ID").asc_nulls_last())
