"""Risk measures of one claim as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rates to USD, the flag thresholds and the tier limits.
RATES_TO_USD = {
    "USD": "1.0000000000",
    "EUR": "1.1111111111",
    "GBP": "1.3333333333",
    "CAD": "0.7407407407",
}
SPIKE_MULTIPLE = 2
SUSPECT_PAYOUT = 50000
TIER_ONE_ABOVE = 10_000_000
TIER_TWO_FROM = 1_000_000

USD = "decimal(18,6)"


def exchange_rate(currency: Column) -> Column:
    """Rate to USD, null for a currency without one."""
    pairs = [F.lit(v) for code, rate in RATES_TO_USD.items() for v in (code, rate)]
    return F.create_map(*pairs)[currency].cast("decimal(12,10)")


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio that is 0 for a zero denominator and null for a missing one."""
    top, bottom = numerator.cast("double"), denominator.cast("double")
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def valuation_tier(valuation_usd: Column) -> Column:
    return (
        F.when(valuation_usd > TIER_ONE_ABOVE, "Tier 1")
        .when(valuation_usd >= TIER_TWO_FROM, "Tier 2")
        .otherwise("Tier 3")
    )


def suspect_flag(spike: Column, base_premium: Column, payout: Column) -> Column:
    """1 where the premium spike and the payout both exceed their limits, 0 elsewhere."""
    hit = (spike > base_premium * SPIKE_MULTIPLE) & (payout > SUSPECT_PAYOUT)
    return F.coalesce(hit.cast("int"), F.lit(0))


def add_risk_features(df: DataFrame) -> DataFrame:
    """Rates, USD amounts, spike, ratios, suspect flag and damage, as stages of plain projections."""
    converted = df.withColumn("EXCHANGE_RATE_USD", exchange_rate(F.col("CURRENCY_CODE"))).withColumns(
        {
            "VALUATION_USD": (F.col("VALUATION_LOCAL") * F.col("EXCHANGE_RATE_USD")).cast(USD),
            "CURRENT_PREMIUM_USD": (F.col("CURRENT_PREMIUM_LOCAL") * F.col("EXCHANGE_RATE_USD")).cast(USD),
        }
    )
    spiked = converted.withColumn(
        "PREMIUM_SPIKE_USD", (F.col("CURRENT_PREMIUM_USD") - F.col("BASE_PREMIUM_USD")).cast(USD)
    )
    return spiked.withColumns(
        {
            "PAYOUT_TO_VALUE_RATIO": guarded_ratio(F.col("PAYOUT_AUTHORIZED"), F.col("VALUATION_USD")),
            "PHANTOM_CLAIM_SUSPECT": suspect_flag(
                F.col("PREMIUM_SPIKE_USD"), F.col("BASE_PREMIUM_USD"), F.col("PAYOUT_AUTHORIZED")
            ),
            "ADJUSTER_KICKBACK_RATIO": guarded_ratio(F.col("ADJUSTER_GRATUITY"), F.col("PAYOUT_AUTHORIZED")),
            # The payout is in local currency and is added as it stands.
            "TOTAL_FINANCIAL_DAMAGE_USD": (F.col("PAYOUT_AUTHORIZED") + F.col("PREMIUM_SPIKE_USD")).cast(USD),
        }
    )
