"""Aggregates over the claims: leaders, totals, trackers and portfolio figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.risk import valuation_tier
from claimlens.operators.cleaning import finite
from claimlens.operators.ordered import attach_lookup, exact_quantiles, first_rows, with_tile

STANDARD_VENDOR = "Standard_Vendor"
SUSPECT = "PHANTOM_CLAIM_SUSPECT = 1"


def mean(column: str) -> Column:
    """Mean from the exact total, so the result does not depend on the order of addition."""
    return F.sum(column).cast("double") / F.count(column)


def suspects(df: DataFrame) -> DataFrame:
    return df.filter(SUSPECT)


def classified(df: DataFrame) -> DataFrame:
    """Claims with an incident classification."""
    return df.filter(F.col("INCIDENT_CLASSIFICATION").isNotNull())


def cohort(df: DataFrame, labels: Sequence[str], column: str, value: str) -> DataFrame:
    """Rows of the labelled cohorts that have a value."""
    return df.filter(F.col(column).isin(list(labels)) & F.col(value).isNotNull()).select(column, value)


def leaders(df: DataFrame, key: str, value: str, out: str, top: int) -> DataFrame:
    """The ``top`` keys by total value; rows without a key do not count, an empty total is 0."""
    totals = df.filter(F.col(key).isNotNull()).groupBy(key)
    return (
        totals.agg(F.coalesce(F.sum(value), F.lit(0)).alias(out)).orderBy(F.col(out).desc(), F.col(key)).limit(top)
    )


def frequent(df: DataFrame, key: str, top: int = 5) -> DataFrame:
    """Most frequent values of a column."""
    counted = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("claims"))
    return counted.orderBy(F.col("claims").desc(), F.col(key)).limit(top)


def top_adjusters(df: DataFrame, top: int = 5) -> DataFrame:
    return leaders(df, "ADJUSTER_ID", "ADJUSTER_GRATUITY", "total_gratuity", top)


def top_contractors(df: DataFrame, top: int = 10) -> DataFrame:
    return leaders(df, "DECODED_CONTRACTOR", "PAYOUT_AUTHORIZED", "total_payout", top)


def suspect_mean_spike(df: DataFrame) -> DataFrame:
    return suspects(df).agg(mean("PREMIUM_SPIKE_USD").alias("mean_premium_spike"))


def total_payout(df: DataFrame) -> DataFrame:
    return df.agg(F.abs(F.coalesce(F.sum("PAYOUT_AUTHORIZED"), F.lit(0))).alias("total_payout"))


def payout_by_manager(df: DataFrame) -> DataFrame:
    known = df.filter(F.col("MANAGER_ID").isNotNull())
    return known.groupBy("MANAGER_ID").agg(
        F.coalesce(F.sum("PAYOUT_AUTHORIZED"), F.lit(0)).alias("total_payout")
    )


def claims_per(df: DataFrame, column: str = "COUNTRY_CODE") -> DataFrame:
    """Rows per value, missing values included."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("claims"))
    return counted.orderBy(F.col(column).asc_nulls_last())


def with_tier(df: DataFrame) -> DataFrame:
    return df.withColumn("valuation_tier", valuation_tier(F.col("VALUATION_USD")))


def ratio_by_tier(df: DataFrame) -> DataFrame:
    """Claims, mean and greatest payout-to-value ratio of each valuation tier."""
    ratio = "PAYOUT_TO_VALUE_RATIO"
    return (
        with_tier(df)
        .groupBy("valuation_tier")
        .agg(
            F.count(F.lit(1)).alias("property_count"),
            F.round(F.avg(ratio), 6).alias("avg_payout_to_value_ratio"),
            F.max(ratio).alias("max_payout_to_value_ratio"),
        )
        .orderBy(F.col("avg_payout_to_value_ratio").desc_nulls_first(), "valuation_tier")
    )


def decile_summary(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Claims and payouts of each payout decile; ``order`` starts with the payout and breaks its ties."""
    deciled = with_tile(df, order, 10, "payout_decile")
    payout = "PAYOUT_AUTHORIZED"
    return (
        deciled.groupBy("payout_decile")
        .agg(
            F.count(F.lit(1)).alias("property_count"),
            F.min(payout).alias("min_payout"),
            F.max(payout).alias("max_payout"),
            mean(payout).alias("avg_payout"),
        )
        .orderBy("payout_decile")
    )


def shell_contractors(df: DataFrame) -> DataFrame:
    """Claims of contractors other than the standard vendor; 'Unknown' counts as one of them."""
    return df.filter(F.col("DECODED_CONTRACTOR").isNotNull() & (F.col("DECODED_CONTRACTOR") != STANDARD_VENDOR))


def contractor_concentration(df: DataFrame, above: int = 3) -> DataFrame:
    """Contractors that work with more than ``above`` adjusters."""
    return (
        shell_contractors(df)
        .groupBy(F.col("DECODED_CONTRACTOR").alias("contractor"))
        .agg(
            F.countDistinct("ADJUSTER_ID").alias("distinct_adjusters"),
            F.sum("PAYOUT_AUTHORIZED").alias("total_payout"),
        )
        .filter(F.col("distinct_adjusters") > above)
        .orderBy(F.col("distinct_adjusters").desc(), F.col("total_payout").desc_nulls_first(), "contractor")
    )


def adjuster_tracker(df: DataFrame) -> DataFrame:
    """Gratuities, distinct shell contractors and payouts of each adjuster."""
    contractor = F.col("DECODED_CONTRACTOR")
    return df.groupBy(F.col("ADJUSTER_ID").alias("adjuster_id")).agg(
        F.sum("ADJUSTER_GRATUITY").alias("total_bribes"),
        F.countDistinct(F.when(contractor != STANDARD_VENDOR, contractor)).alias("unique_shell_companies"),
        F.sum("PAYOUT_AUTHORIZED").alias("total_authorized_payouts"),
    )


def contractor_tracker(df: DataFrame) -> DataFrame:
    """Incidents, payouts and mean premium spike of each shell contractor."""
    return (
        shell_contractors(df)
        .groupBy(F.col("DECODED_CONTRACTOR").alias("contractor"))
        .agg(
            F.count(F.lit(1)).alias("total_incidents"),
            F.sum("PAYOUT_AUTHORIZED").alias("total_payout_stolen"),
            mean("PREMIUM_SPIKE_USD").alias("avg_premium_spike"),
        )
    )


def premium_deviation(df: DataFrame, column: str = "CURRENT_PREMIUM_USD") -> DataFrame:
    """Mean absolute deviation of the premium about its mean; the mean is a one-row subquery."""
    centre = df.agg(mean(column).alias("m")).scalar()
    deviation = F.abs(F.col(column).cast("double") - F.col("_mean"))
    return df.select(column).withColumn("_mean", centre).agg(F.avg(deviation).alias("mean_absolute_deviation"))


def monthly_gratuity(df: DataFrame) -> DataFrame:
    dated = df.filter(F.col("INCIDENT_DATE").isNotNull())
    month = F.trunc(F.col("INCIDENT_DATE").cast("date"), "month").cast("timestamp_ntz")
    return dated.groupBy(month.alias("month")).agg(mean("ADJUSTER_GRATUITY").alias("mean_gratuity"))


def daily_spike(df: DataFrame) -> DataFrame:
    """Mean premium spike per incident time."""
    dated = df.filter(F.col("INCIDENT_DATE").isNotNull())
    return dated.groupBy("INCIDENT_DATE").agg(mean("PREMIUM_SPIKE_USD").alias("mean_spike"))


def payout_by_property_type(df: DataFrame) -> DataFrame:
    """Count, mean, exact median, deviation and total of the payouts of each property type."""
    payout = "PAYOUT_AUTHORIZED"
    known = df.filter(F.col("PROPERTY_TYPE").isNotNull())
    totals = known.groupBy("PROPERTY_TYPE").agg(
        F.count(payout).alias("count"),
        mean(payout).alias("mean"),
        F.stddev_samp(F.col(payout).cast("double")).alias("std"),
        F.coalesce(F.sum(payout), F.lit(0)).alias("sum"),
    )
    medians = exact_quantiles(known, [payout], [0.5], ["PROPERTY_TYPE"]).select(
        "PROPERTY_TYPE", F.col("quantiles")[0].alias("median")
    )
    return attach_lookup(totals, medians, ["PROPERTY_TYPE"]).orderBy(F.col("sum").desc(), "PROPERTY_TYPE")


def describe_payouts(df: DataFrame, column: str = "PAYOUT_AUTHORIZED") -> DataFrame:
    """Mean, exact median, deviation, extremes and count of the payouts."""
    value = F.col(column)
    moments = df.agg(
        mean(column).alias("mean"),
        F.stddev_samp(value.cast("double")).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(value).alias("count"),
    )
    median = exact_quantiles(df, [column], [0.5]).agg(F.max(F.col("quantiles")[0]).alias("median")).scalar()
    return moments.withColumn("median", median)


def box_statistics(df: DataFrame, labels: Sequence[str], group: str, value: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and outlier count of each cohort."""
    members = cohort(df, labels, group, value)
    quartiles = exact_quantiles(members, [value], [0.25, 0.5, 0.75], [group]).select(
        group, *[F.col("quantiles")[i].alias(q) for i, q in enumerate(("q1", "median", "q3"))]
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    number = F.col(value).cast("double")
    inside = (number >= F.col("q1") - reach) & (number <= F.col("q3") + reach)
    # One row of quartiles per requested label.
    sided = attach_lookup(members, quartiles, [group], bounded=True)
    return sided.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, number)).alias("low_whisker"),
        F.max(F.when(inside, number)).alias("high_whisker"),
        F.count_if(~inside).alias("outliers"),
        F.count(F.lit(1)).alias("claims"),
    )


def portfolio_figures(df: DataFrame) -> DataFrame:
    """Rows, payouts and damage of the whole portfolio and of its suspect claims."""
    suspect = F.col("PHANTOM_CLAIM_SUSPECT") == 1
    payout, damage = F.col("PAYOUT_AUTHORIZED"), F.col("TOTAL_FINANCIAL_DAMAGE_USD")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(payout).alias("total_payout_authorized"),
        F.sum(damage).alias("total_financial_damage"),
        F.count_if(suspect).alias("phantom_claim_count"),
        F.sum(F.when(suspect, payout)).alias("suspect_payout"),
        F.sum(F.when(suspect, damage)).alias("suspect_damage"),
    )


def top_suspect_adjusters(df: DataFrame, top: int = 5) -> DataFrame:
    return top_adjusters(suspects(df), top)


def top_suspect_managers(df: DataFrame, top: int = 5) -> DataFrame:
    return leaders(suspects(df), "MANAGER_ID", "TOTAL_FINANCIAL_DAMAGE_USD", "total_financial_damage", top)


def top_suspect_contractors(df: DataFrame, top: int = 5) -> DataFrame:
    return top_contractors(suspects(df), top)


def policy_review(df: DataFrame, top: int = 5) -> DataFrame:
    """Suspect claims with the greatest damage."""
    columns = [
        "PROPERTY_ID",
        "MANAGER_ID",
        "ADJUSTER_ID",
        "DECODED_CONTRACTOR",
        "PAYOUT_AUTHORIZED",
        "PREMIUM_SPIKE_USD",
        "TOTAL_FINANCIAL_DAMAGE_USD",
        "PAYOUT_TO_VALUE_RATIO",
    ]
    order = [F.col("TOTAL_FINANCIAL_DAMAGE_USD").desc(), *columns]
    return suspects(df).select(*columns).orderBy(*order).limit(top)


def audit_rows(df: DataFrame, order: Sequence[str], limit: int = 150_000) -> DataFrame:
    """Suspect claims for the audit file, at most ``limit`` of them in the given order."""
    return first_rows(suspects(df), order, limit)


def finite_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features with infinities and NaN taken as missing."""
    return df.withColumns({c: finite(F.col(c)) for c in columns})
