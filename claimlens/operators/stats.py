"""Statistical screening; every figure comes from one or two aggregates over the whole table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.parsing import leading_digit
from claimlens.functions.tails import two_sided_t
from claimlens.operators.ordered import attach_lookup, stored, value_positions


@F.pandas_udf(T.DoubleType())
def t_probability(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value; applied to result tables of one row."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else two_sided_t(a, b) for a, b in zip(t, df)], dtype="float64")


def welch_test(
    df: DataFrame,
    first: str = "Apex Restoration",
    second: str = "Global Rebuild",
    group: str = "DECODED_CONTRACTOR",
    value: str = "PAYOUT_AUTHORIZED",
) -> DataFrame:
    """Welch's t-test that the first cohort's mean exceeds the second's; fails below two values a cohort.

    Two cohorts without any variation have no t statistic: it and all that follows from it are null.
    """
    number = F.col(value).cast("double")
    measures = []
    for name, label in (("first", first), ("second", second)):
        member = F.when(F.col(group) == label, number)
        total = F.sum(F.when(F.col(group) == label, F.col(value))).cast("double")
        measures += [
            F.count(member).alias(f"{name}_count"),
            (total / F.nullif(F.count(member), F.lit(0))).alias(f"{name}_mean"),
            F.var_samp(member).alias(f"{name}_variance"),
        ]
    n1, n2 = F.col("first_count"), F.col("second_count")
    e1, e2 = F.try_divide(F.col("first_variance"), n1), F.try_divide(F.col("second_variance"), n2)
    t = F.try_divide(F.col("first_mean") - F.col("second_mean"), F.sqrt(e1 + e2))
    too_few = F.raise_error(F.lit("the t-test needs two values in each cohort")).cast("double")
    tested = df.agg(*measures).select(
        "first_count",
        "second_count",
        "first_mean",
        "second_mean",
        F.when((n1 < 2) | (n2 < 2), too_few).otherwise(t).alias("t_statistic"),
        F.try_divide(F.pow(e1 + e2, F.lit(2)), F.try_divide(e1 * e1, n1 - 1) + F.try_divide(e2 * e2, n2 - 1)).alias("degrees_of_freedom"),
    )
    p = F.col("two_sided_p_value")
    return (
        tested.withColumn("two_sided_p_value", t_probability("t_statistic", "degrees_of_freedom"))
        .withColumn("one_sided_p_value", F.when(F.col("t_statistic") > 0, p / 2).otherwise(1 - p / 2))
        .withColumn("significant_at_0_05", F.col("one_sided_p_value") < 0.05)
    )


def benford_digits(df: DataFrame, column: str = "PAYOUT_AUTHORIZED") -> DataFrame:
    """Leading digits 1-9 of the positive amounts against their Benford shares, in one aggregate."""
    digit = leading_digit(F.col(column))
    counts = df.select(digit.alias("digit")).agg(
        *[F.count_if(F.col("digit") == d).alias(str(d)) for d in range(1, 10)], F.count("digit").alias("observations")
    )
    rows = F.array(*[F.struct(F.lit(d).alias("digit"), F.col(str(d)).alias("observed")) for d in range(1, 10)])
    share = F.col("observed") / F.nullif(F.col("observations"), F.lit(0))
    expected = F.log10(1 + 1 / F.col("digit"))
    return (
        counts.select("observations", F.inline(rows))
        .withColumn("observed_share", share)
        .withColumn("expected_share", expected)
        .withColumn("abs_deviation", F.abs(share - expected))
    )


def benford_test(df: DataFrame, column: str = "PAYOUT_AUTHORIZED") -> DataFrame:
    """Mean absolute deviation of the digit shares, and chi-square with its p-value for 8 degrees."""
    gap = F.col("observed_share") - F.col("expected_share")
    tested = benford_digits(df, column).agg(
        F.max("observations").alias("observations"),
        F.avg("abs_deviation").alias("mean_absolute_deviation"),
        F.sum(F.col("observations") * gap * gap / F.col("expected_share")).alias("chi_square"),
    )
    half = F.col("chi_square") / 2
    # An even number of degrees gives the tail a closed form.
    tail = F.exp(-half) * (1 + half * (1 + half / 2 * (1 + half / 3)))
    return tested.withColumn("chi_square_p_value", tail)


def _with_p(result: DataFrame, r: str, out: str) -> DataFrame:
    """p-value of a correlation over ``observations`` pairs: 1 for two pairs, null where there is no coefficient."""
    free = F.col("observations") - 2
    t = F.when(F.abs(r) < 1, F.col(r) * F.sqrt(free / (1 - F.col(r) * F.col(r)))).otherwise(F.lit(float("inf")))
    p = F.when(free == 0, F.lit(1.0)).otherwise(t_probability(t, free.cast("double")))
    return result.withColumn(out, F.when(F.col(r).isNotNull() & ~F.isnan(r), p))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)


def pearson(df: DataFrame, x: str = "VALUATION_USD", y: str = "PAYOUT_AUTHORIZED") -> DataFrame:
    """Linear correlation; null over a constant column, which has none."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    sums = _pairs(df, x, y).agg(
        varied.alias("varied"),
        F.covar_pop(a, b).alias("xy"),
        F.stddev_pop(a).alias("xx"),
        F.stddev_pop(b).alias("yy"),
        F.count(F.lit(1)).alias("observations"),
    )
    r = F.when(F.col("varied"), F.try_divide(F.col("xy"), F.col("xx") * F.col("yy")))
    return _with_p(sums.select(r.alias("pearson_r"), "observations"), "pearson_r", "pearson_p_value")


def average_ranks(pairs: DataFrame, column: str, out: str, ranges: int | None = None) -> DataFrame:
    """Mean rank of each distinct value, ties sharing theirs; ``_n`` weighs the rows."""
    positions = value_positions(pairs, column, weight="_n", ranges=ranges)
    return positions.select(column, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out))


def spearman(
    df: DataFrame, x: str = "VALUATION_USD", y: str = "PAYOUT_AUTHORIZED", ranges: int | None = None
) -> DataFrame:
    """Rank correlation with mean ranks on ties.

    Equal pairs are counted first and stored; ranks belong to distinct values, never to single rows. The
    ranks are centred on their known mean, which keeps the sums exact to rounding.
    """
    pairs = stored(_pairs(df, x, y).groupBy(x, y).agg(F.count(F.lit(1)).alias("_n")))
    ranked = attach_lookup(pairs, average_ranks(pairs, x, "_rx", ranges), [x])
    ranked = attach_lookup(ranked, average_ranks(pairs, y, "_ry", ranges), [y])
    centre = pairs.agg(((F.sum("_n") + 1) / 2).alias("c")).scalar()
    ranked = ranked.withColumn("_c", centre)
    dx, dy, n = F.col("_rx") - F.col("_c"), F.col("_ry") - F.col("_c"), F.col("_n")
    sums = ranked.agg(
        F.sum(n * dx * dy).alias("xy"),
        F.sum(n * dx * dx).alias("xx"),
        F.sum(n * dy * dy).alias("yy"),
        F.sum(n).alias("observations"),
    )
    rho = F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))
    return _with_p(sums.select(rho.alias("spearman_rho"), "observations"), "spearman_rho", "spearman_p_value")


def fitted_line(df: DataFrame, x: str = "VALUATION_USD", y: str = "PAYOUT_AUTHORIZED") -> DataFrame:
    """Least-squares line of y on x."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return _pairs(df, x, y).agg(
        F.regr_slope(a, b).alias("slope"),
        F.regr_intercept(a, b).alias("intercept"),
        F.regr_r2(a, b).alias("r_squared"),
        F.count(F.lit(1)).alias("observations"),
    )
