"""Running totals of arriving claims by their incident date, with late claims set aside.

Each batch of the stream is stored as it came. The high mark is the latest incident date of all batches before it; a claim
that lies more than ``delay_days`` before that mark is late. Late claims go to a table of their own for review and leave
the totals as they are; the others are added up per adjuster and merged with the totals of the batch before. Every batch
writes folders of its own number from those of the one before, so a batch that runs again after a failure gives the same
tables. Adding up is partial before the shuffle, so a hot adjuster is one row per task, and the state that is merged
has one row per adjuster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TOTALS = "ADJUSTER_ID string, claims bigint, suspects bigint, payout decimal(38,2), last_incident timestamp_ntz"


def _place(folder: str, table: str, batch: int) -> str:
    return f"{folder}/{table}-{batch}"


def arrival_totals(claims: DataFrame) -> DataFrame:
    """Claims, suspect claims, payout and latest incident of each adjuster, in a form that can be merged."""
    return claims.groupBy("ADJUSTER_ID").agg(
        F.count(F.lit(1)).alias("claims"),
        F.sum("PHANTOM_CLAIM_SUSPECT").cast("bigint").alias("suspects"),
        F.sum("PAYOUT_AUTHORIZED").cast("decimal(38,2)").alias("payout"),
        F.max("INCIDENT_DATE").alias("last_incident"),
    )


def merged_totals(before: DataFrame, more: DataFrame) -> DataFrame:
    return (
        before.unionByName(more)
        .groupBy("ADJUSTER_ID")
        .agg(
            F.sum("claims").alias("claims"),
            F.sum("suspects").alias("suspects"),
            F.sum("payout").cast("decimal(38,2)").alias("payout"),
            F.max("last_incident").alias("last_incident"),
        )
    )


def is_late(high, delay_days: int) -> Column:
    """Whether a claim lies before the mark by more than the delay; a claim without a date is never late."""
    if high is None:
        return F.lit(False)
    return F.coalesce(F.col("INCIDENT_DATE") < F.lit(high) - F.make_dt_interval(F.lit(delay_days)), F.lit(False))


def fold_batch(batch: DataFrame, number: int, folder: str, delay_days: int) -> None:
    """Bring the tables of the folder from the batch before to this one."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(_place(folder, "arrived", number))
    arrived = spark.read.schema(batch.schema).parquet(_place(folder, "arrived", number))
    before = spark.read.schema("high timestamp_ntz").parquet(_place(folder, "high", number - 1)).first() if number else None
    late = is_late(before.high if before else None, delay_days)
    arrived.filter(late).write.mode("overwrite").parquet(_place(folder, "late", number))
    totals = arrival_totals(arrived.filter(~late))
    if number:
        totals = merged_totals(load_totals(spark, folder, number - 1), totals)
    totals.write.mode("overwrite").parquet(_place(folder, "totals", number))
    high = arrived.agg(F.max("INCIDENT_DATE").alias("high"))
    if before is not None:
        high = high.select(F.greatest("high", F.lit(before.high).cast("timestamp_ntz")).alias("high"))
    high.write.mode("overwrite").parquet(_place(folder, "high", number))


def start_arrivals(stream: DataFrame, folder: str, checkpoint: str, delay_days: int = 30) -> StreamingQuery:
    """Fold all that has arrived since the last run into the folder's tables, then stop."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: fold_batch(batch, number, folder, delay_days))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def load_totals(spark: SparkSession, folder: str, number: int) -> DataFrame:
    return spark.read.schema(TOTALS).parquet(_place(folder, "totals", number))


def load_late(spark: SparkSession, folder: str, numbers: range, schema) -> DataFrame:
    """The late claims of the given batches."""
    return spark.read.schema(schema).parquet(*[_place(folder, "late", n) for n in numbers])
