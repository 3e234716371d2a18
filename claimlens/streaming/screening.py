"""Continuous screening: arriving claims are scored with a saved forest and routed to a review table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimlens.operators.anomaly import FEATURES, anomalies, score
from claimlens.operators.cleaning import finite

KEY = ["PROPERTY_ID", "INCIDENT_DATE"]


def thin_repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key within each Arrow batch, so a hot key reaches the shuffle as few rows."""
    names = list(keys)

    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.Table.from_batches([batch]).select(names).append_column("row", pa.array(range(len(batch))))
            rows = numbered.group_by(names).aggregate([("row", "min")])["row_min"].combine_chunks()
            yield batch.take(rows)

    return df.mapInArrow(first_rows, df.schema)


def review_queue(
    arriving: DataFrame,
    forest: dict,
    medians: dict[str, float],
    features: Sequence[str] = FEATURES,
    memory: str = "7 days",
) -> DataFrame:
    """Anomalous claims among the arriving ones, each property and date once.

    Claims are scored first, so that only anomalous ones are remembered. Repeats are recognized for ``memory``
    after arrival; the watermark follows the time of arrival, so an old incident date never makes a claim late.
    Gaps take the medians found when the forest was grown.
    """
    filled = {
        f"_f{i}": F.coalesce(finite(F.col(c).cast("double")), F.lit(medians[c])) for i, c in enumerate(features)
    }
    flagged = anomalies(score(arriving.withColumns(filled), forest))
    once = (
        thin_repeats(flagged, KEY)
        .withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", memory)
        .dropDuplicatesWithinWatermark(KEY)
    )
    return once.drop("_arrived")


def start_review(queue: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append the queue to Parquet, working through all files present and then stopping."""
    return (
        queue.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
