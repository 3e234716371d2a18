"""Every registered query by name: (spark, data folder) -> DataFrame.

Results are turned into plain types at the end: amounts as double, counts as bigint, times as text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions import risk
from claimlens.operators import (
    anomaly,
    cleaning,
    graph,
    insights,
    marts,
    ordered,
    profiles,
    quality,
    stats,
    summary,
    trackers,
    windows,
)
from claimlens.plans import pipeline
from claimlens.session import scratch_path
from claimlens.sources import files
from claimlens.sources.tables import ROW_POS, claims, damaged_claims, first_claims, first_typed_claims, typed_claims, with_measures
from claimlens.streaming import arrivals, screening

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Columns that order claims of one property and date; equal in all of them, claims are interchangeable.
CLAIM_ORDER = [
    "MANAGER_ID",
    "ADJUSTER_ID",
    "PAYOUT_AUTHORIZED",
    "ADJUSTER_GRATUITY",
    "BASE_PREMIUM_USD",
    "CURRENT_PREMIUM_LOCAL",
    "COUNTRY_CODE",
    "INCIDENT_CLASSIFICATION",
]
# Columns that name a claim and fix its features: claims equal in them are interchangeable in a sample.
FOREST_KEY = [
    "PROPERTY_ID", "INCIDENT_DATE", "MANAGER_ID", "ADJUSTER_ID", "PAYOUT_AUTHORIZED", "ADJUSTER_GRATUITY", "PREMIUM_SPIKE_USD", "VALUATION_USD",
]
COHORTS = ["Apex Restoration", "Global Rebuild"]


def plain(df: DataFrame) -> DataFrame:
    def column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, T.IntegralType):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, T.TimestampNTZType):
            return c.cast("string").alias(f.name)
        return c

    return df.select(*[column(f) for f in df.schema.fields])


def query(build: Query) -> Query:
    """Register a query under its function's name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(build(spark, folder))

    QUERIES[build.__name__] = run
    return build


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), d) for c, d in digits.items()})


def portfolio(spark: SparkSession, folder: str) -> DataFrame:
    """Claims with one row per property and date."""
    return first_claims(spark, folder, CLAIM_ORDER).drop(ROW_POS)


def mart_of_portfolio(spark: SparkSession, folder: str) -> DataFrame:
    """The mart of the portfolio, whose measures are made where they are read."""
    typed = first_typed_claims(spark, folder, CLAIM_ORDER).drop(ROW_POS)
    return marts.reporting_mart(typed, measures=with_measures)


def raw_claims(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.standardize_names(damaged_claims(spark, folder), keep=[ROW_POS])


# Scans, sources and sinks


@query
def raw_csv_claims(spark, folder):
    """Damaged claims written as CSV, scanned with the fixed schema and read field by field."""
    path = scratch_path(spark, "raw_csv")
    files.write_csv(damaged_claims(spark, folder).drop(ROW_POS), path, compression="gzip")
    read = cleaning.standardize_names(files.read_raw_csv(spark, path), keep=[ROW_POS])
    parsed = read.transform(cleaning.parse_dates).transform(cleaning.extract_metadata)
    return parsed.drop(ROW_POS)


# Files of unequal size, smallest manager numbers in the middle one.
FILE_OF_MANAGER = "CASE WHEN MANAGER_ID < 'MGR-110' THEN 2 WHEN MANAGER_ID < 'MGR-150' THEN 0 ELSE 1 END"
LINE_ORDER = ["PAYOUT_AUTHORIZED", "ADJUSTER_GRATUITY", "ADJUSTER_ID", "MANAGER_ID", "VALUATION_LOCAL", "BASE_PREMIUM_USD", "CURRENT_PREMIUM_LOCAL"]


@query
def first_in_file_order(spark, folder):
    """Claims with tidy ids written to several raw files and scanned back: the first of each property and date."""
    path = scratch_path(spark, "ordered_csv")
    rows = ordered.stored_by_column(typed_claims(spark, folder).drop(ROW_POS).withColumn("_file", F.expr(FILE_OF_MANAGER)))
    metadata = F.concat(
        F.lit('{"payout_authorized": '), F.col("PAYOUT_AUTHORIZED").cast("string"),
        F.lit(', "adjuster_gratuity": '), F.col("ADJUSTER_GRATUITY").cast("string"), F.lit("}"),
    )
    for number in range(3):
        part = rows.filter(F.col("_file") == number).orderBy(*ordered.ascending(*LINE_ORDER))
        # The header's order is not that of the schema.
        text = part.select("MANAGER_ID", metadata.alias("Insurance Metadata JSON"), *[c for c in CSV_COLUMNS if c != "MANAGER_ID"])
        files.write_csv(text, f"{path}/{number}", compression="gzip")
    read = files.read_raw_csv(spark, f"{path}/*").transform(cleaning.parse_dates).transform(cleaning.extract_metadata)
    first = cleaning.keep_first(read, [ROW_POS])
    return first.select("PROPERTY_ID", "INCIDENT_DATE", *LINE_ORDER)


CSV_COLUMNS = [
    "PROPERTY_ID", "INCIDENT_DATE", "MANAGER_ID", "ADJUSTER_ID", "PROPERTY_TYPE", "CURRENCY_CODE", "SQUARE_FOOTAGE",
    "VALUATION_LOCAL", "CURRENT_PREMIUM_LOCAL", "BASE_PREMIUM_USD", "COUNTRY_CODE",
]


@query
def mart_csv_coercion(spark, folder):
    """An exported CSV holding unreadable amounts and dates, read back with both coerced."""
    path = scratch_path(spark, "mart_csv")
    suspect = F.col("PHANTOM_CLAIM_SUSPECT") == 1
    exported = claims(spark, folder).select(
        "PROPERTY_ID",
        F.when(suspect, "pending").otherwise(F.col("INCIDENT_DATE").cast("string")).alias("INCIDENT_DATE"),
        F.when(F.col("PAYOUT_AUTHORIZED") == 0, "n/a")
        .otherwise(F.col("PAYOUT_AUTHORIZED").cast("string"))
        .alias("PAYOUT_AUTHORIZED"),
        "VALUATION_USD",
    )
    files.write_csv(exported, path)
    return files.read_mart_csv(spark, path, exported.columns)


def _partitioned(spark, folder) -> str:
    path = scratch_path(spark, "by_country")
    files.write_partitioned(
        claims(spark, folder).select("PROPERTY_ID", "PAYOUT_AUTHORIZED", "INCIDENT_DATE", "COUNTRY_CODE"), path
    )
    return path


@query
def partitioned_claims(spark, folder):
    """Claims written by country and read back with the country from the folder names."""
    return files.read_partitioned(spark, _partitioned(spark, folder))


@query
def partition_property_ids(spark, folder):
    """Only the property column and the partition key are scanned."""
    read = files.read_partitioned(spark, _partitioned(spark, folder), ["PROPERTY_ID", "COUNTRY_CODE"])
    return read.groupBy("COUNTRY_CODE").agg(
        F.count("PROPERTY_ID").alias("claims"), F.countDistinct("PROPERTY_ID").alias("properties")
    )


@query
def country_backfill(spark, folder):
    """Claims that lost their country get the one listed for their property."""
    known = claims(spark, folder).select("PROPERTY_ID", "INCIDENT_DATE", "MANAGER_ID", "COUNTRY_CODE")
    lost = known.withColumn("COUNTRY_CODE", F.when(F.col("MANAGER_ID") >= "MGR-200", F.col("COUNTRY_CODE")))
    return cleaning.backfill(lost, known.filter(F.col("MANAGER_ID") < "MGR-200").select("PROPERTY_ID", "COUNTRY_CODE"))


@query
def backfill_in_place(spark, folder):
    """The same, on a stored table by country, of which only the partitions that change are rewritten."""
    path = scratch_path(spark, "backfilled")
    known = claims(spark, folder).select("PROPERTY_ID", "INCIDENT_DATE", "MANAGER_ID", "COUNTRY_CODE")
    lost = F.when(F.col("MANAGER_ID") >= "MGR-200", F.col("COUNTRY_CODE"))
    files.write_partitioned(known.withColumn("COUNTRY_CODE", lost), path)
    files.backfill_partitions(spark, path, known.filter(F.col("MANAGER_ID") < "MGR-200").select("PROPERTY_ID", "COUNTRY_CODE"))
    return files.read_partitioned(spark, path)


@query
def loaded_table(spark, folder):
    """Ratios stored as a table of the catalog, undefined ones as null."""
    zero = F.col("PAYOUT_AUTHORIZED") == 0
    ratio = F.when(zero, float("nan")).otherwise(F.col("ADJUSTER_KICKBACK_RATIO")).alias("ADJUSTER_KICKBACK_RATIO")
    return files.load_table(claims(spark, folder).select("PROPERTY_ID", "INCIDENT_DATE", ratio), f"ratios_{uuid.uuid4().hex}")


@query
def nan_to_null(spark, folder):
    """A stored table in which undefined ratios arrive as null."""
    zero = F.col("PAYOUT_AUTHORIZED") == 0
    undefined = claims(spark, folder).select(
        "PROPERTY_ID",
        "INCIDENT_DATE",
        F.when(zero, float("nan")).otherwise(F.col("ADJUSTER_KICKBACK_RATIO")).alias("ADJUSTER_KICKBACK_RATIO"),
    )
    path = scratch_path(spark, "loaded")
    files.nan_to_null(undefined).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query
def quoted_rank_file(spark, folder):
    """The adjuster ranks written as fully quoted CSV and read back."""
    path = scratch_path(spark, "ranks_csv")
    ranks = windows.rank_adjusters(claims(spark, folder))
    files.write_csv(ranks, path, quote_all=True)
    return spark.read.schema(ranks.schema).options(**files.CSV_FORM).csv(path)


@query
def manager_payout_json(spark, folder):
    """Manager -> payout pairs as JSON, written and parsed back."""
    path = scratch_path(spark, "managers_json")
    pairs = files.as_json_pairs(summary.payout_by_manager(claims(spark, folder)), "MANAGER_ID", "total_payout")
    files.write_json(pairs, path)
    read = spark.read.schema("json string").json(path)
    return read.select(
        F.explode(F.from_json("json", "map<string,decimal(28,2)>")).alias("MANAGER_ID", "total_payout")
    )


@query
def clustered_layout(spark, folder):
    """Claims stored in order of adjuster and date, and read back."""
    path = scratch_path(spark, "clustered")
    rows = claims(spark, folder).select("ADJUSTER_ID", "INCIDENT_DATE", "PROPERTY_ID", "PAYOUT_AUTHORIZED", ROW_POS)
    files.write_clustered(rows, path, spread=[ROW_POS])
    return spark.read.parquet(path).drop(ROW_POS)


# Cleaning and projections


@query
def mixed_dates(spark, folder):
    return raw_claims(spark, folder).transform(cleaning.parse_dates).select("PROPERTY_ID", "MANAGER_ID", "INCIDENT_DATE")


@query
def imputed_dates(spark, folder):
    dated = raw_claims(spark, folder).select("PROPERTY_ID", "MANAGER_ID", "INCIDENT_DATE").transform(cleaning.parse_dates)
    return cleaning.add_date_parts(cleaning.impute_dates(dated))


@query
def missing_dates(spark, folder):
    return cleaning.missing_dates(raw_claims(spark, folder).select("INCIDENT_DATE"))


@query
def metadata_fields(spark, folder):
    read = cleaning.extract_metadata(raw_claims(spark, folder))
    return read.select(
        "PROPERTY_ID", "INCIDENT_CLASSIFICATION", "PAYOUT_AUTHORIZED", "CONTRACTOR_A85", "ADJUSTER_GRATUITY"
    )


@query
def decoded_contractors(spark, folder):
    read = cleaning.extract_metadata(raw_claims(spark, folder)).transform(cleaning.decode_contractors)
    return read.select("PROPERTY_ID", "MANAGER_ID", "DECODED_CONTRACTOR")


@query
def contractor_frequency(spark, folder):
    read = cleaning.extract_metadata(raw_claims(spark, folder)).transform(cleaning.decode_contractors)
    return summary.frequent(read, "DECODED_CONTRACTOR")


@query
def classified_claims(spark, folder):
    read = cleaning.extract_metadata(raw_claims(spark, folder))
    return summary.classified(read).select("PROPERTY_ID", "MANAGER_ID", "INCIDENT_CLASSIFICATION")


def _derived(spark, folder):
    return pipeline.derive(ordered.stored_by_column(damaged_claims(spark, folder)))


@query
def unknown_currencies(spark, folder):
    return cleaning.unknown_currencies(
        raw_claims(spark, folder).withColumn("EXCHANGE_RATE_USD", risk.exchange_rate(F.col("CURRENCY_CODE")))
    )


@query
def risk_features(spark, folder):
    """Every measure of a claim, before deduplication and imputation, from the damaged form."""
    return risk.add_risk_features(cleaning.extract_metadata(raw_claims(spark, folder))).select(
        "PROPERTY_ID",
        "EXCHANGE_RATE_USD",
        "VALUATION_USD",
        "CURRENT_PREMIUM_USD",
        "PREMIUM_SPIKE_USD",
        "PAYOUT_TO_VALUE_RATIO",
        "PHANTOM_CLAIM_SUSPECT",
        "ADJUSTER_KICKBACK_RATIO",
        "TOTAL_FINANCIAL_DAMAGE_USD",
    )


@query
def clean_portfolio(spark, folder):
    """The whole cleaning pipeline on the damaged claims, stored once as a raw table would be: 28 columns."""
    raw = ordered.stored_by_column(damaged_claims(spark, folder).drop(ROW_POS))
    return pipeline.clean(raw, order=[*CLAIM_ORDER, "CURRENCY_CODE", "CONTRACTOR_A85"])


@query
def median_imputation(spark, folder):
    """Exact medians in place of missing numbers."""
    gappy = claims(spark, folder).select(
        "PROPERTY_ID",
        F.when(F.col("QUARTER") != 1, F.col("PAYOUT_AUTHORIZED")).alias("PAYOUT_AUTHORIZED"),
        F.when(F.col("QUARTER") != 2, F.col("VALUATION_USD")).alias("VALUATION_USD"),
        F.when(F.col("QUARTER") != 3, F.col("SQUARE_FOOTAGE").cast("double")).alias("SQUARE_FOOTAGE"),
    )
    return cleaning.impute_medians(ordered.stored(gappy))


@query
def text_cleanup(spark, folder):
    """Missing text filled, then all text trimmed."""
    text = raw_claims(spark, folder).select("PROPERTY_ID", "MANAGER_ID", "PROPERTY_TYPE", "COUNTRY_CODE")
    gappy = text.withColumn("PROPERTY_TYPE", F.when(F.col("COUNTRY_CODE") != "US", F.col("PROPERTY_TYPE")))
    blank = gappy.withColumn("COUNTRY_CODE", F.when(F.col("COUNTRY_CODE") == "UK", " \t ").otherwise(F.col("COUNTRY_CODE")))
    return blank.transform(cleaning.fill_text).transform(cleaning.strip_text)


@query
def valuation_tiers(spark, folder):
    return summary.with_tier(claims(spark, folder)).select("PROPERTY_ID", "VALUATION_USD", "valuation_tier")


@query
def cohort_payouts(spark, folder):
    return summary.cohort(claims(spark, folder), COHORTS, "DECODED_CONTRACTOR", "PAYOUT_AUTHORIZED")


@query
def finite_features(spark, folder):
    """Infinite and undefined features replaced by the median of the rest."""
    ratio = F.col("PAYOUT_TO_VALUE_RATIO")
    spoiled = claims(spark, folder).select(
        "PROPERTY_ID",
        F.when(F.col("COUNTRY_CODE") == "CA", float("inf"))
        .when(F.col("COUNTRY_CODE") == "FR", float("nan"))
        .otherwise(ratio)
        .alias("PAYOUT_TO_VALUE_RATIO"),
    )
    kept = summary.finite_features(spoiled, ["PAYOUT_TO_VALUE_RATIO"])
    return cleaning.impute_medians(kept, ["PAYOUT_TO_VALUE_RATIO"])


# Deduplication and quality


@query
def duplicate_count(spark, folder):
    return cleaning.duplicate_count(typed_claims(spark, folder))


@query
def deduplicated_claims(spark, folder):
    return portfolio(spark, folder).select("PROPERTY_ID", "INCIDENT_DATE", *CLAIM_ORDER)


@query
def premium_violations(spark, folder):
    return quality.premium_violations(claims(spark, folder))


@query
def row_count(spark, folder):
    return quality.row_count(claims(spark, folder))


@query
def column_types(spark, folder):
    """Position, name and type of each column of the claims, with the number of rows that hold a value."""
    rows = claims(spark, folder).select("PROPERTY_ID", "INCIDENT_DATE", "VALUATION_LOCAL", "YEAR", "DECODED_CONTRACTOR", "PAYOUT_TO_VALUE_RATIO")
    counted = rows.agg(*[F.count(c).alias(c) for c in rows.columns])
    filled = counted.unpivot([], rows.columns, "column_name", "filled")
    return quality.column_types(rows).drop("nullable").join(filled, "column_name")


@query
def country_completeness(spark, folder):
    return quality.completeness(claims(spark, folder))


@query
def null_counts(spark, folder):
    return quality.null_counts(_derived(spark, folder).select(*pipeline.COLUMNS))


@query
def null_total(spark, folder):
    return quality.null_total(_derived(spark, folder).select(*pipeline.COLUMNS))


PROFILED = ["PROPERTY_TYPE", "COUNTRY_CODE", "DECODED_CONTRACTOR", "SQUARE_FOOTAGE", "VALUATION_LOCAL", "PAYOUT_AUTHORIZED"]


@query
def column_profile(spark, folder):
    profiled = ordered.stored(typed_claims(spark, folder).select(*PROFILED))
    return rounded(quality.profile(profiled), mean=4, stddev=4)


@query
def merged_profile(spark, folder):
    """The profile of all claims from states stored year by year; distinct values within four standard errors."""
    path = scratch_path(spark, "profiles")
    rows = ordered.stored(claims(spark, folder).select(*PROFILED, "YEAR"))
    profiles.profile_states(rows, PROFILED, F.col("YEAR")).write.partitionBy("part").parquet(path)
    found = profiles.merged_profile(spark.read.parquet(path))
    exact = rows.agg(*[F.countDistinct(c).alias(c) for c in PROFILED]).unpivot([], PROFILED, "column_name", "distinct_count")
    error = F.abs(F.col("distinct_estimate") - F.col("distinct_count"))
    close = error <= 4 * 0.0163 * F.col("distinct_count")
    kept = ["column_name", "row_count", "null_count", "min_text", "max_text", "min_number", "max_number", "mean"]
    return rounded(found.join(exact, "column_name").select(*kept, "distinct_count", close.alias("distinct_close")), mean=4)


# Aggregates


@query
def top_adjusters(spark, folder):
    return summary.top_adjusters(claims(spark, folder))


@query
def top_contractors(spark, folder):
    return summary.top_contractors(typed_claims(spark, folder))


@query
def suspect_mean_spike(spark, folder):
    return summary.suspect_mean_spike(claims(spark, folder))


@query
def total_payout(spark, folder):
    return summary.total_payout(claims(spark, folder))


@query
def payout_by_manager(spark, folder):
    return summary.payout_by_manager(claims(spark, folder))


@query
def claims_per_country(spark, folder):
    return summary.claims_per(claims(spark, folder))


@query
def ratio_by_tier(spark, folder):
    return summary.ratio_by_tier(claims(spark, folder))


@query
def decile_summary(spark, folder):
    return summary.decile_summary(claims(spark, folder), ["PAYOUT_AUTHORIZED", ROW_POS])


@query
def contractor_concentration(spark, folder):
    return summary.contractor_concentration(claims(spark, folder))


@query
def adjuster_tracker(spark, folder):
    return summary.adjuster_tracker(claims(spark, folder))


@query
def contractor_tracker(spark, folder):
    return summary.contractor_tracker(claims(spark, folder))


@query
def refreshed_trackers(spark, folder):
    """Both trackers written once and read back, as one list."""
    adjusters, contractors = marts.refresh_trackers(claims(spark, folder), scratch_path(spark, "trackers"))
    return adjusters.select(
        F.col("adjuster_id").alias("tracked"), F.col("total_authorized_payouts").cast("double").alias("payout")
    ).unionByName(
        contractors.select(
            F.col("contractor").alias("tracked"), F.col("total_payout_stolen").cast("double").alias("payout")
        )
    )


@query
def incremental_trackers(spark, folder):
    """Both trackers after a base load and two refreshes, each from its own new claims alone."""
    path, rows = scratch_path(spark, "tracker_state"), claims(spark, folder)
    parts = [F.col("YEAR") < 1995, F.col("YEAR").between(1995, 1996), (F.col("YEAR") > 1996) | F.col("YEAR").isNull()]
    for version, part in enumerate(parts):
        state = trackers.refresh_state(rows.filter(part), path, version)
    adjusters = trackers.adjusters_of(state).select(
        F.lit("adjuster").alias("kind"),
        F.col("adjuster_id").alias("tracked"),
        F.col("total_authorized_payouts").cast("double").alias("payout"),
        F.col("total_bribes").cast("double").alias("measure"),
        F.col("unique_shell_companies").alias("number"),
    )
    contractors = trackers.contractors_of(state).select(
        F.lit("contractor").alias("kind"),
        F.col("contractor").alias("tracked"),
        F.col("total_payout_stolen").cast("double").alias("payout"),
        F.col("avg_premium_spike").alias("measure"),
        F.col("total_incidents").alias("number"),
    )
    return adjusters.unionByName(contractors)


@query
def pareto_managers(spark, folder):
    return rounded(windows.pareto_managers(claims(spark, folder)), cumulative_share=10)


@query
def cumulative_damage(spark, folder):
    return rounded(windows.cumulative_damage(claims(spark, folder)), cumulative_share=10)


@query
def premium_deviation(spark, folder):
    return rounded(summary.premium_deviation(claims(spark, folder)), mean_absolute_deviation=6)


@query
def monthly_gratuity(spark, folder):
    return summary.monthly_gratuity(claims(spark, folder))


@query
def daily_spike(spark, folder):
    return summary.daily_spike(claims(spark, folder))


@query
def spike_trend(spark, folder):
    return rounded(windows.spike_trend(claims(spark, folder)), rolling_mean_spike=9)


@query
def payout_by_property_type(spark, folder):
    return rounded(summary.payout_by_property_type(claims(spark, folder)), std=4)


@query
def payout_statistics(spark, folder):
    return rounded(summary.describe_payouts(claims(spark, folder)), std=4)


@query
def box_statistics(spark, folder):
    return summary.box_statistics(claims(spark, folder), COHORTS, "DECODED_CONTRACTOR", "PAYOUT_AUTHORIZED")


# Sequences, ranks and running totals


@query
def rank_adjusters_by_country(spark, folder):
    return windows.rank_adjusters(claims(spark, folder))


@query
def repeat_claims(spark, folder):
    return windows.repeat_claims(claims(spark, folder), [ROW_POS])


@query
def payout_deciles(spark, folder):
    ties = ["PROPERTY_ID", "INCIDENT_DATE", "MANAGER_ID", "ADJUSTER_ID"]
    rows = ordered.stored_by_column(claims(spark, folder).select("PAYOUT_AUTHORIZED", *ties, ROW_POS))
    return windows.payout_deciles(rows, [*ties, ROW_POS], is_stored=True).drop(ROW_POS)


@query
def running_damage(spark, folder):
    ties = ["TOTAL_FINANCIAL_DAMAGE_USD", ROW_POS]
    rows = claims(spark, folder).select("COUNTRY_CODE", "INCIDENT_DATE", "PROPERTY_ID", *ties)
    return windows.running_damage(rows, ties).drop(ROW_POS)


@query
def first_suspect_claims(spark, folder):
    return windows.first_suspect_claims(claims(spark, folder))


# Mart and relationships


@query
def reporting_mart(spark, folder):
    return mart_of_portfolio(spark, folder)


@query
def mart_preview(spark, folder):
    mart = marts.mart_preview(mart_of_portfolio(spark, folder))
    return mart.select("PROPERTY_ID", "INCIDENT_DATE", "payout_decile", "adjuster_rank", "first_corrupt_claim")


@query
def claim_paths(spark, folder):
    return graph.claim_paths(portfolio(spark, folder))


@query
def walked_paths(spark, folder):
    """The same paths found by walking the edge list."""
    return graph.walk(graph.relationship_edges(ordered.stored(summary.suspects(portfolio(spark, folder)))))


@query
def suspect_network(spark, folder):
    """All that the managers of the highest suspect damage are connected with, and in how many steps."""
    rows = ordered.stored(summary.suspects(claims(spark, folder)))
    return graph.reachable(graph.network_edges(rows), summary.top_suspect_managers(rows).select("MANAGER_ID"))


@query
def relationship_concentration(spark, folder):
    return graph.relationship_concentration(claims(spark, folder))


# Portfolio figures


@query
def portfolio_figures(spark, folder):
    return summary.portfolio_figures(claims(spark, folder))


@query
def top_suspect_adjusters(spark, folder):
    return summary.top_suspect_adjusters(claims(spark, folder))


@query
def top_suspect_managers(spark, folder):
    return summary.top_suspect_managers(claims(spark, folder))


@query
def top_suspect_contractors(spark, folder):
    return summary.top_suspect_contractors(claims(spark, folder))


@query
def policy_review(spark, folder):
    return summary.policy_review(claims(spark, folder))


@query
def audit_rows(spark, folder):
    columns = ["PROPERTY_ID", "INCIDENT_DATE", *CLAIM_ORDER, "TOTAL_FINANCIAL_DAMAGE_USD"]
    rows = claims(spark, folder).select(*columns, "PHANTOM_CLAIM_SUSPECT", ROW_POS)
    return summary.audit_rows(rows, [*columns, ROW_POS]).drop(ROW_POS)


@query
def fixed_sample(spark, folder):
    """A seeded sample of 50,000 claims."""
    return ordered.fixed_sample(claims(spark, folder).select(*FOREST_KEY), 50_000, FOREST_KEY)


@query
def sample_identities(spark, folder):
    """Of a sample of 1,000 claims: its size, its distinct rows, and how many of them the claims hold."""
    rows = ordered.stored_by_column(claims(spark, folder).select("PROPERTY_ID", "INCIDENT_DATE", "MANAGER_ID", ROW_POS))
    drawn = ordered.stored(ordered.fixed_sample(rows, 1_000, [ROW_POS]))
    found = rows.join(drawn.select(ROW_POS), ROW_POS, "left_semi").agg(F.count("*").alias("found")).scalar()
    return drawn.agg(F.count("*").alias("size"), F.countDistinct(ROW_POS).alias("distinct_rows")).withColumn("found", found)


# Statistics


@query
def correlations_with_a_constant(spark, folder):
    """Both correlations over a column that never varies: there is none, and no p-value."""
    rows = claims(spark, folder).select(F.lit(7).alias("FLAT"), "PAYOUT_AUTHORIZED")
    linear, ranked = stats.pearson(rows, "FLAT"), stats.spearman(rows, "FLAT")
    return linear.crossJoin(ranked.drop("observations"))


@query
def welch_of_constant_cohorts(spark, folder):
    """The t-test over two cohorts that each hold one value only."""
    flat = F.when(F.col("DECODED_CONTRACTOR") == COHORTS[0], 3).otherwise(5).alias("PAYOUT_AUTHORIZED")
    return stats.welch_test(claims(spark, folder).select("DECODED_CONTRACTOR", flat))


@query
def welch_test(spark, folder):
    digits = dict(t_statistic=8, degrees_of_freedom=4, two_sided_p_value=7, one_sided_p_value=7)
    return rounded(stats.welch_test(claims(spark, folder)), **digits)


@query
def benford_digits(spark, folder):
    return rounded(stats.benford_digits(claims(spark, folder)), observed_share=10, expected_share=10, abs_deviation=10)


@query
def benford_test(spark, folder):
    return rounded(stats.benford_test(claims(spark, folder)), mean_absolute_deviation=10, chi_square=5, chi_square_p_value=9)


@query
def pearson_correlation(spark, folder):
    return rounded(stats.pearson(claims(spark, folder)), pearson_r=9, pearson_p_value=7)


@query
def spearman_correlation(spark, folder):
    return rounded(stats.spearman(claims(spark, folder)), spearman_rho=9, spearman_p_value=7)


@query
def fitted_line(spark, folder):
    return rounded(stats.fitted_line(claims(spark, folder)), slope=10, intercept=4, r_squared=10)


# Anomalies


def _scored(spark, folder):
    return anomaly.isolation_forest(ordered.stored(claims(spark, folder).select(*anomaly.ANOMALY_COLUMNS)), FOREST_KEY)


@query
def forest_nodes(spark, folder):
    """The forest itself: every node of every tree."""
    nodes = anomaly.fit_forest(anomaly.feature_matrix(claims(spark, folder).select(*anomaly.ANOMALY_COLUMNS)), FOREST_KEY)
    # A leaf has no threshold.
    return rounded(nodes.withColumn("threshold", F.when(F.col("low") != F.col("node"), F.col("threshold"))), path=9)


@query
def anomaly_scores(spark, folder):
    return rounded(anomaly.anomalies(_scored(spark, folder)), isolation_forest_score=9)


@query
def anomaly_rate(spark, folder):
    return rounded(anomaly.anomaly_rate(_scored(spark, folder)), anomaly_rate=12)


@query
def anomalies_by_country(spark, folder):
    return anomaly.anomalies_by_country(_scored(spark, folder))


@query
def insight_document(spark, folder):
    """All results in one JSON document, read from claims stored once."""
    stored = ordered.stored_by_column(claims(spark, folder))
    scored = anomaly.isolation_forest(stored, [ROW_POS])
    kept = scored.select(*anomaly.ANOMALY_COLUMNS, "isolation_forest_flag", "isolation_forest_score")
    return insights.insights(stored, ordered.stored(kept))


# What arrives of a claim: all of the anomaly table that does not follow from the rest.
ARRIVING = [
    "PROPERTY_ID",
    "INCIDENT_DATE",
    "MANAGER_ID",
    "ADJUSTER_ID",
    "COUNTRY_CODE",
    "PROPERTY_TYPE",
    "CURRENCY_CODE",
    "DECODED_CONTRACTOR",
    "PAYOUT_AUTHORIZED",
    "ADJUSTER_GRATUITY",
    "VALUATION_LOCAL",
    "CURRENT_PREMIUM_LOCAL",
    "BASE_PREMIUM_USD",
]


def _arriving(spark, folder):
    """The claims of the portfolio from files, as a table and as a stream; their measures are made where they are read."""
    path = scratch_path(spark, "arriving")
    first_typed_claims(spark, folder, CLAIM_ORDER).select(*ARRIVING).write.parquet(path, compression="zstd")
    stored = spark.read.parquet(path)
    stream = spark.readStream.schema(stored.schema).parquet(path)
    return tuple(with_measures(rows).select(*anomaly.ANOMALY_COLUMNS) for rows in (stored, stream))


@query
def streamed_review(spark, folder):
    """Stored claims arrive as a stream, are scored with a saved forest and land in the review table."""
    forest, sink, state = (scratch_path(spark, n) for n in ("forest", "review", "review_state"))
    known, stream = _arriving(spark, folder)
    matrix = anomaly.feature_matrix(known)
    anomaly.save_forest(anomaly.fit_forest(matrix, ["PROPERTY_ID", "INCIDENT_DATE"]), forest)
    medians = ordered.exact_medians(known, anomaly.FEATURES)
    queue = screening.review_queue(stream, anomaly.load_forest(spark, forest), medians)
    screening.start_review(queue, sink, state).awaitTermination()
    return rounded(spark.read.schema(queue.schema).parquet(sink), isolation_forest_score=9)


# A forest written down, so that SQL can walk it: tree, node, feature, threshold, low, high, path, sample.
LITERAL_FOREST = [
    (0, 0, 0, 40000.0, 1, 2, 0.0, 8),
    (0, 1, 1, 900.5, 3, 4, 0.0, 8),
    (0, 2, 2, 2500.25, 5, 6, 0.0, 8),
    (0, 3, 0, float("inf"), 3, 3, 4.5, 8),
    (0, 4, 0, float("inf"), 4, 4, 3.0, 8),
    (0, 5, 0, float("inf"), 5, 5, 2.5, 8),
    (0, 6, 0, float("inf"), 6, 6, 2.0, 8),
    (1, 0, 5, 9000000.0, 1, 2, 0.0, 8),
    (1, 1, 3, 45000.75, 3, 4, 0.0, 8),
    (1, 2, 4, 0.0015, 5, 6, 0.0, 8),
    (1, 3, 0, float("inf"), 3, 3, 4.0, 8),
    (1, 4, 0, float("inf"), 4, 4, 2.0, 8),
    (1, 5, 0, float("inf"), 5, 5, 3.5, 8),
    (1, 6, 0, float("inf"), 6, 6, 1.5, 8),
]


def _literal_forest(spark):
    return anomaly.forest_arrays(spark.createDataFrame(LITERAL_FOREST, anomaly.NODE_SCHEMA))


def _literal_scored(spark, folder):
    return anomaly.score(anomaly.feature_matrix(claims(spark, folder)), _literal_forest(spark))


@query
def literal_forest_scores(spark, folder):
    """All claims scored by a small forest that SQL can walk as well."""
    scored = _literal_scored(spark, folder).select("PROPERTY_ID", "INCIDENT_DATE", "MANAGER_ID", "isolation_forest_flag", "isolation_forest_score")
    return rounded(scored, isolation_forest_score=9)


@query
def literal_forest_rate(spark, folder):
    return rounded(anomaly.anomaly_rate(_literal_scored(spark, folder)), anomaly_rate=12)


@query
def literal_forest_countries(spark, folder):
    return anomaly.anomalies_by_country(_literal_scored(spark, folder))


@query
def literal_streamed_review(spark, folder):
    """Stored claims arrive as a stream and are scored with the written forest."""
    sink, state = (scratch_path(spark, n) for n in ("review", "review_state"))
    known, stream = _arriving(spark, folder)
    queue = screening.review_queue(stream, _literal_forest(spark), ordered.exact_medians(known, anomaly.FEATURES))
    screening.start_review(queue, sink, state).awaitTermination()
    return rounded(spark.read.schema(queue.schema).parquet(sink).select("PROPERTY_ID", "INCIDENT_DATE", "isolation_forest_score"), isolation_forest_score=9)


@query
def insight_figures(spark, folder):
    """Figures read back from the insight document, without its forest."""
    document = insights.insights(ordered.stored_by_column(claims(spark, folder)))
    places = {
        "t_statistic": "t_test.t_statistic",
        "benford_observations": "benfords_law.observations",
        "chi_square": "benfords_law.chi_square",
        "pearson_r": "pearson.pearson_r",
        "spearman_rho": "spearman.spearman_rho",
        "pareto_managers": "pareto.manager_count",
        "premium_mad": "premium_mad",
        "monthly_rows": "monthly_rows",
        "daily_rows": "daily_rows",
        "payouts": "claim_payout_descriptive_statistics.count",
    }
    return document.select(*[F.round(F.get_json_object("insights", f"$.{p}").cast("double"), 4).alias(n) for n, p in places.items()])


# Which of three batches brings a claim: older ones first, and those of some managers one batch later.
ARRIVAL = "least(2, CASE WHEN YEAR < 1995 THEN 0 WHEN YEAR < 1997 THEN 1 ELSE 2 END + CASE WHEN MANAGER_ID LIKE '%7' THEN 1 ELSE 0 END)"


@query
def event_time_totals(spark, folder):
    """Claims arriving in three batches: totals per adjuster by incident date, and how many claims came too late."""
    arriving, tables, state = (scratch_path(spark, n) for n in ("arriving", "arrivals", "arrivals_state"))
    columns = ["ADJUSTER_ID", "INCIDENT_DATE", "PHANTOM_CLAIM_SUSPECT", "PAYOUT_AUTHORIZED"]
    rows = ordered.stored(claims(spark, folder).select(*columns, F.expr(ARRIVAL).alias("_batch")))
    schema = rows.select(*columns).schema
    for number in range(3):
        rows.filter(F.col("_batch") == number).select(*columns).write.mode("append").parquet(arriving)
        arrivals.start_arrivals(spark.readStream.schema(schema).parquet(arriving), tables, state).awaitTermination()
    late = arrivals.load_late(spark, tables, range(3), schema).groupBy("ADJUSTER_ID")
    late = late.agg(F.count("*").alias("late_claims"), F.sum("PAYOUT_AUTHORIZED").alias("late_payout"))
    joined = arrivals.load_totals(spark, tables, 2).join(late, "ADJUSTER_ID", "full")
    return joined.fillna(0, subset=["claims", "suspects", "late_claims"])
