"""The three stages as jobs: clean the raw claims, run the relational reports, run the statistics.

Every result is written below one output folder; later stages read what earlier ones wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimlens.operators import anomaly, graph, marts, quality, stats, summary, windows
from claimlens.operators.insights import insights
from claimlens.operators.ordered import stored, stored_by_column
from claimlens.plans import pipeline
from claimlens.sources import files
from claimlens.sources.tables import ROW_POS, with_row_position

KEY = ["PROPERTY_ID", "INCIDENT_DATE"]


def prepare(spark: SparkSession, raw_csv: str, out: str) -> DataFrame:
    """Raw CSV to the cleaned table by country, the audit file and the payout of each manager.

    The CSV is parsed once. The reports on all rows, before duplicates go, are written as well.
    """
    text = stored_by_column(files.read_raw_text(spark, raw_csv))
    files.write_csv(files.unparsed(text), f"{out}/reports/unparsed")
    derived = stored_by_column(pipeline.derive(files.type_raw(text)))
    files.write_csv(summary.top_adjusters(derived), f"{out}/reports/top_adjusters")
    files.write_csv(summary.top_contractors(derived), f"{out}/reports/top_contractors")
    files.write_csv(summary.suspect_mean_spike(derived), f"{out}/reports/suspect_mean_spike")
    cleaned = quality.require_premiums(pipeline.finish(derived, [ROW_POS]))
    files.write_partitioned(cleaned, f"{out}/claims")
    claims = files.read_partitioned(spark, f"{out}/claims", pipeline.COLUMNS)
    files.write_csv(summary.audit_rows(claims, KEY), f"{out}/audit")
    files.write_json(
        files.as_json_pairs(summary.payout_by_manager(claims), "MANAGER_ID", "total_payout"), f"{out}/manager_payouts"
    )
    return claims


def relate(spark: SparkSession, out: str) -> DataFrame:
    """Cleaned table to ranks, repeat claims, relationship paths, trackers and the wide mart."""
    claims = files.read_partitioned(spark, f"{out}/claims", pipeline.COLUMNS)
    files.write_csv(windows.rank_adjusters(claims), f"{out}/reports/adjuster_ranks", quote_all=True)
    placed = with_row_position(spark.read.parquet(f"{out}/claims"))
    files.write_csv(windows.repeat_claims(placed, [ROW_POS]), f"{out}/reports/repeat_claims")
    files.write_csv(windows.first_suspect_claims(claims), f"{out}/reports/first_suspect_claims")
    files.write_csv(summary.contractor_concentration(claims), f"{out}/reports/contractor_concentration")
    files.write_csv(summary.ratio_by_tier(claims), f"{out}/reports/ratio_by_tier")
    files.write_csv(summary.decile_summary(placed, ["PAYOUT_AUTHORIZED", ROW_POS]), f"{out}/reports/payout_deciles")
    files.write_csv(graph.claim_paths(claims), f"{out}/reports/claim_paths")
    files.write_csv(graph.relationship_concentration(claims), f"{out}/reports/relationships")
    trackers = marts.refresh_trackers(claims, f"{out}/trackers")
    marts.reporting_mart(claims, *trackers).write.mode("overwrite").parquet(f"{out}/mart")
    mart = spark.read.parquet(f"{out}/mart")
    files.write_csv(mart, f"{out}/mart_csv")
    return mart


def diagnose(spark: SparkSession, out: str) -> DataFrame:
    """Mart to the insight document, Pareto managers, anomalies, trends and payout statistics."""
    mart = spark.read.parquet(f"{out}/mart")
    scored = stored(anomaly.isolation_forest(mart, KEY))
    files.write_csv(anomaly.anomalies(scored), f"{out}/reports/anomalies")
    files.write_csv(windows.pareto_managers(mart), f"{out}/reports/pareto_managers")
    files.write_csv(summary.describe_payouts(mart), f"{out}/reports/payout_statistics")
    files.write_csv(summary.monthly_gratuity(mart), f"{out}/reports/monthly_gratuity")
    files.write_csv(windows.spike_trend(mart), f"{out}/reports/spike_trend")
    files.write_csv(stats.fitted_line(mart), f"{out}/reports/fitted_line")
    profiled = [c for c in mart.columns if c not in ("INSURANCE_METADATA_JSON", "CONTRACTOR_A85")]
    quality.profile(mart, profiled).write.mode("overwrite").parquet(f"{out}/profile")
    document = insights(mart, scored)
    document.write.mode("overwrite").text(f"{out}/insights")
    return document


def register_views(claims: DataFrame, mart: DataFrame | None = None) -> None:
    """The table and view names SQL users know, over the cleaned claims."""
    # The names of the table and its views.
    claims.createOrReplaceTempView("reit_portfolio")
    summary.adjuster_tracker(claims).createOrReplaceTempView("vw_adjuster_tracker")
    summary.contractor_tracker(claims).createOrReplaceTempView("vw_contractor_tracker")
    if mart is not None:
        mart.createOrReplaceTempView("vw_powerbi_dataset")


def materialize_trackers(claims: DataFrame, out: str) -> None:
    """The stored form of the trackers, under their own view names."""
    adjusters, contractors = marts.refresh_trackers(claims, f"{out}/trackers")
    adjusters.createOrReplaceTempView("mv_adjuster_tracker")
    contractors.createOrReplaceTempView("mv_contractor_tracker")
