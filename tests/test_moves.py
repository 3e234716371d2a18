"""What moves: rows that need not be shuffled, stored or sorted a second time stay where they are."""

from __future__ import annotations

import contextlib
import glob
import io

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.operators import anomaly, marts, ordered
from claimlens.operators.ordered import ascending
from claimlens.plans import catalog, pipeline
from claimlens.sources import tables

# Two orders of one customer, one order without a customer; part 2 is listed twice.
ROWS = {
    "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, 3)]),
    "customer": ("c_custkey bigint, c_nationkey int", [(205, 1), (7, 0)]),
    "orders": ("o_orderkey bigint, o_custkey bigint", [(1, 205), (2, 205), (3, 7), (4, 99), (5, None)]),
    "part": ("p_partkey bigint, p_type string, p_size int, p_retailprice double", [(1, "SMALL X", 3, 10.5), (2, "PROMO Y", 2, 1.0), (2, "PROMO Y", 2, 1.0)]),
}
LINES = [
    (1, 1, 5, 1, 4.0, 100.25, -0.1, 0.05, "R", "F", "1996-01-01 00:00:00"),
    (2, 1, 5, 1, 4.0, 100.25, 0.1, 0.05, "N", "O", "1996-01-01 00:00:00"),
    (3, 2, 6, 1, 2.0, 50.0, 0.0, None, "R", None, "1996-01-02 00:00:00"),
    (3, 2, 6, 2, 2.0, None, 0.0, 0.01, None, "F", None),
    (4, 1, 5, 1, 2.0, 50.0, 0.0, 0.01, "R", "F", "1996-01-03 00:00:00"),
    (5, None, 5, 1, 2.0, 50.0, 0.0, 0.01, "R", "F", "1996-01-03 00:00:00"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders"))
    for name, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    text = tables.TABLES["lineitem"].replace("l_shipdate timestamp_ntz", "l_shipdate string")
    lines = spark.createDataFrame(LINES, text).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    lines.coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.fixture
def shuffled_joins(spark):
    """No table is small enough to be sent to all tasks, and plans are shown as they will run."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.debug.maxToStringFields": "1000"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def exchanges(df, *names):
    """The hash exchanges that claims pass, told by their date or the names given."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    parts = [p for p in out.getvalue().split("\n\n") if ") Exchange" in p and "hashpartitioning" in p]
    return [p for p in parts if any(n in p for n in names or ("l_shipdate", "INCIDENT_DATE"))]


def test_claims_move_once_for_their_order_and_once_for_their_part(spark, folder, shuffled_joins):
    assert len(exchanges(tables.claims(spark, folder))) == 2


def test_first_claims_do_not_move_again(spark, folder, shuffled_joins):
    first = tables.first_claims(spark, folder, ["MANAGER_ID", "ADJUSTER_ID", "PAYOUT_AUTHORIZED"])
    assert len(exchanges(first)) == 2
    rows = collected(first.select("PROPERTY_ID", F.col("INCIDENT_DATE").cast("string"), F.col("PAYOUT_AUTHORIZED").cast("string")))
    assert rows == [
        ("PRP-0000001", "1996-01-01 00:00:00", "0.00"),
        ("PRP-0000002", "1996-01-02 00:00:00", "50.00"),
        ("PRP-0000002", None, "0.00"),
    ]


def test_amounts_of_claims(spark, folder):
    got = tables.claims(spark, folder).select(
        "MANAGER_ID", "COUNTRY_CODE", "INCIDENT_CLASSIFICATION", *[F.col(c).cast("string") for c in ("PAYOUT_AUTHORIZED", "ADJUSTER_GRATUITY", "CURRENT_PREMIUM_LOCAL")]
    )
    assert collected(got.distinct()) == [
        ("MGR-105", "DE", "Structural Fire", "100.25", "5.01", "5200.00"),
        ("MGR-105", "DE", "Water Damage", "0.00", "0.00", "5200.00"),
        ("MGR-107", "US", "Structural Fire", "0.00", "0.00", "1020.00"),
        ("MGR-107", "US", "Water Damage", "50.00", None, "1020.00"),
    ]


def test_tiles_sort_only_the_rows_near_their_limits(spark, monkeypatch):
    """With few sampled keys, too: what they miss makes for more rows, not for other tiles."""
    df = ordered.stored_by_column(spark.range(20_000).select((F.col("id") * 7919 % 1000).alias("v"), "id"))
    sorted_rows, full = [], ordered.ordered_ranges

    def counted(rows, *args):
        sorted_rows.append(rows.count())
        return full(rows, *args)

    monkeypatch.setattr(ordered, "ordered_ranges", counted)
    want = collected(df.withColumn("t", F.ntile(10).over(Window.orderBy(*ascending("v", "id")))))
    assert collected(ordered.with_tile(df, ["v", "id"], 10, "t")) == want
    assert sorted_rows[0] < 10_000
    monkeypatch.setattr(ordered, "SAMPLED", 300)
    monkeypatch.setattr(ordered, "DEVIATIONS", 0.1)
    assert collected(ordered.with_tile(df, ["v", "id"], 10, "t", is_stored=True)) == want


def test_cleaning_moves_and_stores_no_measures(spark, folder, monkeypatch):
    """The first claims are stored as read; the cleaned table is that of measures added before."""
    raw = ordered.stored(tables.damaged_claims(spark, folder))
    order = ["MANAGER_ID", "ADJUSTER_ID", "PAYOUT_AUTHORIZED", "ADJUSTER_GRATUITY", tables.ROW_POS]
    want = collected(pipeline.finish(pipeline.derive(raw), order))
    kept, full = [], pipeline.stored_by_column

    def seen(df):
        kept.append(set(df.columns))
        return full(df)

    monkeypatch.setattr(pipeline, "stored_by_column", seen)
    got = pipeline.clean(raw, order)
    assert got.columns == list(pipeline.COLUMNS) and collected(got) == want
    assert not kept[0] & {"YEAR", "VALUATION_USD", "PREMIUM_SPIKE_USD", "DECODED_CONTRACTOR", "TOTAL_FINANCIAL_DAMAGE_USD"}
    by_measure = pipeline.clean(raw, ["TOTAL_FINANCIAL_DAMAGE_USD", *order])
    assert by_measure.count() == len(want)


def test_mart_moves_wide_rows_once_for_ranks_and_trackers(spark, folder, shuffled_joins):
    """Once for the running damage, once for country and adjuster, once each for the first claims and the contractors."""
    rows = ordered.stored(tables.claims(spark, folder).drop(tables.ROW_POS))
    mart = marts.reporting_mart(rows, ranges=3)
    assert len(exchanges(mart, "VALUATION_LOCAL")) == 4
    # A missing country has a tracker and no rank; a missing adjuster has neither.
    gaps = ordered.stored(rows.limit(1).withColumns({"PHANTOM_CLAIM_SUSPECT": F.lit(1), "COUNTRY_CODE": F.lit(None).cast("string")}))
    found = marts.reporting_mart(gaps, ranges=3).first()
    assert found.adjuster_rank is None and found.fake_payout_total is None and found.adjuster_total_authorized_payouts is not None
    found = marts.reporting_mart(ordered.stored(gaps.withColumn("ADJUSTER_ID", F.lit(None).cast("string"))), ranges=3).first()
    assert found.adjuster_total_authorized_payouts is None and found.first_corrupt_claim == 1


def test_mart_moves_no_measures(spark, folder, shuffled_joins):
    typed = ordered.stored(tables.typed_claims(spark, folder).drop(tables.ROW_POS))
    mart = marts.reporting_mart(typed, ranges=3, measures=tables.with_measures)
    assert len(exchanges(mart, "VALUATION_LOCAL")) == 4
    moved = exchanges(mart, "VALUATION_LOCAL")[:3]
    assert not [p for p in moved if "PAYOUT_TO_VALUE_RATIO" in p]
    whole = marts.reporting_mart(tables.with_measures(typed), ranges=3)
    assert mart.columns == whole.columns and collected(mart) == collected(whole)


@pytest.mark.parametrize("name", ["raw_csv_claims", "first_in_file_order"])
def test_scratch_csv_is_compressed(spark, folder, monkeypatch, name):
    written, full = [], catalog.files.write_csv

    def seen(df, path, **options):
        full(df, path, **options)
        written.append(path)

    monkeypatch.setattr(catalog.files, "write_csv", seen)
    catalog.QUERIES[name](spark, folder).count()
    files = [f for p in written for f in glob.glob(f"{p.removeprefix('file:')}/part-*")]
    assert files and all(f.endswith(".csv.gz") for f in files)


def test_arriving_claims_are_stored_without_their_measures(spark, folder, monkeypatch):
    paths, full = [], catalog.scratch_path
    monkeypatch.setattr(catalog, "scratch_path", lambda s, name: (paths.append(full(s, name)), paths[-1])[1])
    want = collected(catalog.portfolio(spark, folder).select(*anomaly.ANOMALY_COLUMNS))
    known, stream = catalog._arriving(spark, folder)
    assert stream.isStreaming and stream.schema == known.schema and collected(known) == want
    stored = spark.read.parquet(paths[0])
    assert not set(stored.columns) & {"VALUATION_USD", "PREMIUM_SPIKE_USD", "TOTAL_FINANCIAL_DAMAGE_USD", "PAYOUT_TO_VALUE_RATIO"}
    files = glob.glob(f"{paths[0].removeprefix('file:')}/part-*")
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_forest_is_saved_after_its_tasks(spark, tmp_path):
    nodes = spark.range(0, 800, 1, 8).withColumn("task", F.spark_partition_id())
    anomaly.save_forest(nodes, f"{tmp_path}/forest")
    assert spark.read.parquet(f"{tmp_path}/forest").select("task").distinct().count() == 8
    assert len(glob.glob(f"{tmp_path}/forest/part-*")) == 1
