"""Trackers kept up to date from new claims alone.

The stored state has one row per adjuster and contractor, with sums and counts that can be merged. It holds all that the
adjuster and the contractor tracker tell, distinct contractors included, and is far smaller than the claims. A refresh
adds up the new claims, merges them with the last state and writes the next version; the claims seen before are not read
again. Each version is a folder of its own, so a refresh that is run twice gives the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators.summary import STANDARD_VENDOR

KEYS = ["adjuster_id", "contractor"]
SUMS = {"claims": "bigint", "gratuity": "decimal(38,2)", "payout": "decimal(38,2)", "spike": "decimal(38,6)", "spikes": "bigint"}


def tracker_state(claims: DataFrame) -> DataFrame:
    """Mergeable sums of the claims by adjuster and contractor; a missing one is a group of its own."""
    found = claims.groupBy(F.col("ADJUSTER_ID").alias("adjuster_id"), F.col("DECODED_CONTRACTOR").alias("contractor")).agg(
        F.count(F.lit(1)).alias("claims"),
        F.sum("ADJUSTER_GRATUITY").alias("gratuity"),
        F.sum("PAYOUT_AUTHORIZED").alias("payout"),
        F.sum("PREMIUM_SPIKE_USD").alias("spike"),
        F.count("PREMIUM_SPIKE_USD").alias("spikes"),
    )
    return found.select(*KEYS, *[F.col(c).cast(t).alias(c) for c, t in SUMS.items()])


def merged(*states: DataFrame) -> DataFrame:
    """One state that tells of the claims of all."""
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*KEYS).agg(*[F.sum(c).cast(t).alias(c) for c, t in SUMS.items()])


def _version(folder: str, version: int) -> str:
    return f"{folder}/state-{version}"


def load_state(spark: SparkSession, folder: str, version: int) -> DataFrame:
    kinds = "adjuster_id string, contractor string, " + ", ".join(f"{c} {t}" for c, t in SUMS.items())
    return spark.read.schema(kinds).parquet(_version(folder, version))


def refresh_state(new_claims: DataFrame, folder: str, version: int) -> DataFrame:
    """Write the given version, from the one before and the new claims; version 0 starts from nothing."""
    spark, state = new_claims.sparkSession, tracker_state(new_claims)
    if version:
        state = merged(load_state(spark, folder, version - 1), state)
    state.write.mode("overwrite").parquet(_version(folder, version))
    return load_state(spark, folder, version)


def adjusters_of(state: DataFrame) -> DataFrame:
    """The adjuster tracker that a state holds. A group of the state is one contractor, so distinct ones are counted."""
    return state.groupBy("adjuster_id").agg(
        F.sum("gratuity").alias("total_bribes"),
        F.count_if(F.col("contractor") != STANDARD_VENDOR).alias("unique_shell_companies"),
        F.sum("payout").alias("total_authorized_payouts"),
    )


def contractors_of(state: DataFrame) -> DataFrame:
    """The contractor tracker that a state holds."""
    return (
        state.filter(F.col("contractor") != STANDARD_VENDOR)
        .groupBy("contractor")
        .agg(
            F.sum("claims").alias("total_incidents"),
            F.sum("payout").alias("total_payout_stolen"),
            (F.sum("spike").cast("double") / F.sum("spikes")).alias("avg_premium_spike"),
        )
    )
