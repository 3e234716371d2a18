"""Trackers from new claims alone, totals of arriving claims by event time, and the walk of a network with cycles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimlens.operators import graph, profiles, summary, trackers
from claimlens.operators.ordered import stored
from claimlens.session import scratch_path
from claimlens.sources import files
from claimlens.streaming import arrivals


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merged_trackers_equal_recomputed_ones(spark, stored_claims):
    folder = scratch_path(spark, "upkeep")
    gappy = stored(
        stored_claims.withColumns(
            {
                "ADJUSTER_ID": F.when(F.col("MONTH") != 5, F.col("ADJUSTER_ID")),
                "DECODED_CONTRACTOR": F.when(F.col("MONTH") != 7, F.col("DECODED_CONTRACTOR")),
                "PREMIUM_SPIKE_USD": F.when(F.col("MONTH") != 9, F.col("PREMIUM_SPIKE_USD")),
            }
        )
    )
    for version in range(4):
        # One refresh brings nothing.
        state = trackers.refresh_state(gappy.filter(F.col("YEAR") % 3 == version), folder, version)
    once = rows(state)
    state = trackers.refresh_state(gappy.filter(F.lit(False)), folder, 3)
    assert rows(state) == once == rows(trackers.tracker_state(gappy))
    for kept, whole in ((trackers.adjusters_of(state), summary.adjuster_tracker(gappy)), (trackers.contractors_of(state), summary.contractor_tracker(gappy))):
        assert rows(kept) == rows(whole)


def test_a_refresh_reads_no_earlier_claims(spark, stored_claims):
    folder = scratch_path(spark, "upkeep")
    trackers.refresh_state(stored_claims.filter("YEAR < 1997"), folder, 0)
    new = stored(stored_claims.filter("YEAR >= 1997"))
    plan = trackers.merged(trackers.load_state(spark, folder, 0), trackers.tracker_state(new))
    # The new claims are checkpointed; of the files, only the state is read.
    assert {f.rsplit("/", 2)[-2] for f in plan.inputFiles()} == {"state-0"}


def test_reachable_in_a_network_with_cycles(spark):
    ring = [(f"r{k}", f"r{(k + 1) % 7}") for k in range(7)]
    # A hub of 300 leaves, each of which leads back to it; a loop; repeated and broken edges; a part apart.
    hub = [("r3", "hub")] + [("hub", f"leaf{k}") for k in range(300)] + [(f"leaf{k}", "hub") for k in range(300)]
    odd = [("r0", "r0"), ("r0", "r1"), ("r0", "r1"), (None, "r2"), ("r2", None), ("x", "y"), ("y", "x")]
    edges = ring + hub + odd
    found = graph.reachable(spark.createDataFrame(edges, "from_node string, to_node string"), spark.createDataFrame([("r0",), ("r0",), ("leaf5",), ("alone",), (None,)], "id string"))

    def walk(root):
        depth, level = {root: 0}, [root]
        while level:
            level = sorted({b for a, b in edges if a in level and b is not None and b not in depth})
            depth |= {b: max(depth.values()) + 1 for b in level}
        return [(root, node, d) for node, d in depth.items()]

    assert rows(found) == sorted(walk("r0") + walk("leaf5") + walk("alone"), key=str)


def test_paths_without_end_are_walked_to_the_end(spark):
    chain = [(f"{k:03}", f"{k + 1:03}") for k in range(25)]
    found = graph.reachable(spark.createDataFrame(chain, "from_node string, to_node string"), spark.createDataFrame([("000",)], "id string"))
    assert found.agg(F.max("depth")).first()[0] == 25


def test_backfill_rewrites_changed_partitions_only(spark):
    path = scratch_path(spark, "partitions")
    held = [("p1", 1, "US"), ("p2", 2, "US"), ("p3", 3, "CA"), ("p4", 4, "DE"), ("p5", 5, None), ("p6", 6, "FR"), (None, 7, "CA")]
    files.write_partitioned(spark.createDataFrame(held, "PROPERTY_ID string, n int, COUNTRY_CODE string").coalesce(1), path)
    parts = lambda: {f.rsplit("/", 2)[-2].split("=")[1]: f for f in spark.read.parquet(path).inputFiles()}
    before = parts()
    listed = [("p1", "US"), ("p5", "CA"), ("p6", "CA"), ("p6", "BE"), ("p9", "XX"), (None, "DE"), ("p4", None)]
    lookup = spark.createDataFrame(listed, "PROPERTY_ID string, COUNTRY_CODE string")
    assert files.backfill_partitions(spark, path, lookup) == ["CA", "FR", None]
    after = parts()
    assert rows(files.read_partitioned(spark, path, ["PROPERTY_ID", "n", "COUNTRY_CODE"])) == sorted(
        [("p1", 1, "US"), ("p2", 2, "US"), ("p3", 3, "CA"), ("p4", 4, "DE"), ("p5", 5, "CA"), ("p6", 6, "CA"), (None, 7, "CA")], key=str
    )
    assert after.keys() == {"US", "CA", "DE"}
    assert (after["US"], after["DE"]) == (before["US"], before["DE"])
    assert files.backfill_partitions(spark, path, lookup) == []
    assert parts() == after


def test_merged_profiles_are_close_to_the_exact_ones(spark):
    df = spark.range(40_000).select(
        (F.col("id") * 7919 % 40_000).alias("n"), F.concat(F.lit("v"), F.col("id") % 900).alias("t"), F.lit(None).cast("double").alias("none"), (F.col("id") % 9).alias("p")
    )
    path = scratch_path(spark, "profiles")
    profiles.profile_states(df, ["n", "t", "none"], F.col("p")).write.parquet(path)
    found = {r.column_name: r for r in profiles.merged_profile(spark.read.parquet(path)).collect()}
    assert (found["n"].row_count, found["n"].null_count, found["n"].min_number, found["n"].max_number, found["n"].mean) == (40_000, 0, 0, 39_999, 19_999.5)
    assert abs(found["n"].distinct_estimate - 40_000) < 4 * 0.0163 * 40_000 and abs(found["t"].distinct_estimate - 900) < 4 * 0.0163 * 900
    for name, share in profiles.QUARTILES.items():
        assert abs(found["n"][name] / 40_000 - share) < 0.03
    assert (found["t"].median, found["t"].mean, found["t"].max_text) == (None, None, "v99")
    assert (found["none"].null_count, found["none"].mean, found["none"].distinct_estimate, found["none"].q1) == (40_000, None, 0, None)


SCHEMA = "ADJUSTER_ID string, INCIDENT_DATE timestamp_ntz, PHANTOM_CLAIM_SUSPECT int, PAYOUT_AUTHORIZED decimal(18,2)"


def claim(adjuster, day, payout):
    return (adjuster, day and dt.datetime(2024, 1, 1) + dt.timedelta(days=day), int(payout > 5), payout)


@pytest.mark.parametrize("delay", [10, 0])
def test_late_claims_are_set_aside(spark, delay):
    from decimal import Decimal

    batches = [
        [("a", 100, 1), ("b", 3, 2), (None, 50, 7), ("a", None, 8)],
        [("a", 89, 10), ("a", 90, 20), ("c", 400, 40)],
        [],
        [("a", 399, 80), ("b", 5, 160), ("b", None, 320), ("c", 401, 640)],
    ]
    folder, path, state = (scratch_path(spark, n) for n in ("tables", "in", "state"))
    totals, late, high = {}, [], None
    for number, batch in enumerate(batches):
        claims = [claim(a, d, Decimal(p)) for a, d, p in batch]
        spark.createDataFrame(claims, SCHEMA).write.mode("append").parquet(path)
        arrivals.start_arrivals(spark.readStream.schema(SCHEMA).parquet(path), folder, state, delay).awaitTermination()
        for row in claims:
            if high and row[1] and row[1] < high - dt.timedelta(days=delay):
                late.append(row)
                continue
            n, s, p, last = totals.get(row[0], (0, 0, 0, None))
            totals[row[0]] = (n + 1, s + row[2], p + row[3], max(filter(None, (last, row[1])), default=None))
        high = max([r[1] for r in claims if r[1]] + ([high] if high else []), default=None)
    assert rows(arrivals.load_totals(spark, folder, 3)) == sorted(((k, *v) for k, v in totals.items()), key=str)
    assert rows(arrivals.load_late(spark, folder, range(4), SCHEMA)) == sorted(late, key=str)
    # A batch that runs again gives the same tables.
    arrivals.fold_batch(spark.createDataFrame([claim(a, d, Decimal(p)) for a, d, p in batches[3]], SCHEMA), 3, folder, delay)
    assert rows(arrivals.load_totals(spark, folder, 3)) == sorted(((k, *v) for k, v in totals.items()), key=str)
