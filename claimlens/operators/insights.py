"""All statistical results in one nested document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.anomaly import FEATURES, anomalies_by_country, anomaly_rate
from claimlens.operators.stats import benford_digits, benford_test, pearson, spearman, welch_test
from claimlens.operators.summary import (
    daily_spike,
    describe_payouts,
    monthly_gratuity,
    payout_by_property_type,
    premium_deviation,
)
from claimlens.operators.windows import pareto_managers


def _one(result: DataFrame, *drop: str):
    """A one-row result as a struct subquery."""
    kept = [c for c in result.columns if c not in drop]
    return result.agg(F.first(F.struct(*kept))).scalar()


def _many(result: DataFrame, *columns: str):
    """A result of few rows as an array subquery, in the order of its first column."""
    return result.agg(F.sort_array(F.collect_list(F.struct(*(columns or result.columns))))).scalar()


def insights(df: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """One row with the document as JSON text.

    Only aggregates enter it. The list of Pareto managers is not among them, as it grows with the number of
    managers; their number and share are, and the list is a table of its own.
    """
    pareto = pareto_managers(df).agg(
        F.count(F.lit(1)).alias("manager_count"),
        F.max("cumulative_share").alias("damage_share"),
    )
    parts = {
        "t_test": _one(welch_test(df)),
        "benfords_law": _one(benford_test(df)),
        "leading_digits": _many(benford_digits(df), "digit", "observed_share", "expected_share", "abs_deviation"),
        "pearson": _one(pearson(df)),
        "spearman": _one(spearman(df)),
        "pareto": _one(pareto),
        "premium_mad": premium_deviation(df).scalar(),
        "monthly_rows": monthly_gratuity(df).agg(F.count(F.lit(1))).scalar(),
        "daily_rows": daily_spike(df).agg(F.count(F.lit(1))).scalar(),
        "property_type_analysis": _many(payout_by_property_type(df)),
        "claim_payout_descriptive_statistics": _one(describe_payouts(df)),
    }
    if scored is not None:
        parts["isolation_forest"] = _one(anomaly_rate(scored))
        parts["anomalies_by_country"] = _many(anomalies_by_country(scored))
        parts["feature_columns"] = F.array(*[F.lit(f) for f in FEATURES])
    document = df.sparkSession.range(1).select(*[c.alias(n) for n, c in parts.items()])
    return document.select(F.to_json(F.struct(*parts)).alias("insights"))
