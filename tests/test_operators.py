"""Identities, limits and failure modes of the operators."""

import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimlens.operators import anomaly, cleaning, graph, marts, quality, stats, summary, windows
from claimlens.operators.insights import insights
from claimlens.operators.ordered import exact_medians, stored
from claimlens.plans import pipeline
from claimlens.plans.catalog import portfolio
from claimlens.session import scratch_path
from claimlens.sources import files
from claimlens.sources.tables import ROW_POS, damaged_claims
from claimlens.streaming import screening


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_parts_add_up(stored_claims):
    figures = summary.portfolio_figures(stored_claims).first()
    assert total(windows.cumulative_damage(stored_claims), "total_damage_usd") == figures.total_financial_damage
    assert total(summary.payout_by_manager(stored_claims), "total_payout") == figures.total_payout_authorized
    assert total(summary.payout_by_property_type(stored_claims), "sum") == figures.total_payout_authorized
    assert total(summary.payout_by_property_type(stored_claims), "count") == figures.row_count
    assert total(windows.adjuster_payouts(stored_claims), "fake_payout_total") == figures.suspect_payout
    review = summary.policy_review(stored_claims).collect()
    assert all(r.TOTAL_FINANCIAL_DAMAGE_USD == r.PAYOUT_AUTHORIZED + r.PREMIUM_SPIKE_USD for r in review)


def test_benford_identities(stored_claims):
    digits = stats.benford_digits(stored_claims).collect()
    test = stats.benford_test(stored_claims).first()
    assert sum(d.observed_share for d in digits) == pytest.approx(1)
    assert test.mean_absolute_deviation == pytest.approx(sum(d.abs_deviation for d in digits) / 9)
    chi = test.observations * sum((d.observed_share - d.expected_share) ** 2 / d.expected_share for d in digits)
    assert test.chi_square == pytest.approx(chi)


def test_pareto_corner_cases(spark):
    one = spark.createDataFrame([("m", Decimal("0"))], "MANAGER_ID string, TOTAL_FINANCIAL_DAMAGE_USD decimal(18,6)")
    assert windows.pareto_managers(one).first().cumulative_share == 0.0
    rows = [(None, Decimal("9")), ("a", Decimal("-2")), ("b", Decimal("3")), ("c", None), ("b", Decimal("1"))]
    df = spark.createDataFrame(rows, one.schema)
    places = {r.MANAGER_ID: (r.place, r.managers) for r in windows.cumulative_damage(df, ranges=3).collect()}
    assert places == {None: (1, 4), "b": (2, 4), "c": (3, 4), "a": (4, 4)}
    assert [r.MANAGER_ID for r in windows.pareto_managers(df).collect()] == [None]


def test_ranks_share_and_leave_gaps(spark):
    rows = [("US", a, Decimal(p), 1) for a, p in (("x", 7), ("y", 9), ("z", 9), ("w", 3))] + [("US", "v", Decimal(99), 0)]
    df = spark.createDataFrame(rows, "COUNTRY_CODE string, ADJUSTER_ID string, PAYOUT_AUTHORIZED decimal(18,2), PHANTOM_CLAIM_SUSPECT int")
    assert {r.ADJUSTER_ID: r.adjuster_rank for r in windows.rank_adjusters(df).collect()} == {"y": 1, "z": 1, "x": 3, "w": 4}


def test_welch_needs_two_values(spark):
    rows = [("Apex Restoration", 1.0), ("Global Rebuild", 2.0), ("Global Rebuild", 3.0)]
    df = spark.createDataFrame(rows, "DECODED_CONTRACTOR string, PAYOUT_AUTHORIZED double")
    with pytest.raises(Exception, match="two values"):
        stats.welch_test(df).collect()


def test_welch_sides(spark):
    low = [("Apex Restoration", float(v)) for v in (1, 2, 3, 4)]
    high = [("Global Rebuild", float(v)) for v in (6, 7, 9, 10)]
    df = spark.createDataFrame(low + high, "DECODED_CONTRACTOR string, PAYOUT_AUTHORIZED double")
    result = stats.welch_test(df).first()
    assert result.t_statistic < 0
    assert result.one_sided_p_value == pytest.approx(1 - result.two_sided_p_value / 2)
    swapped = stats.welch_test(df, "Global Rebuild", "Apex Restoration").first()
    assert swapped.one_sided_p_value == pytest.approx(result.two_sided_p_value / 2)
    assert swapped.significant_at_0_05


def test_premium_rules(spark):
    schema = "CURRENT_PREMIUM_LOCAL double, BASE_PREMIUM_USD double, CURRENT_PREMIUM_USD double"
    good = spark.createDataFrame([(1.0, 0.0, 2.0)], schema)
    assert quality.require_premiums(good) is good
    bad = spark.createDataFrame([(1.0, -1.0, None)], schema)
    with pytest.raises(ValueError, match="BASE_PREMIUM_USD"):
        quality.require_premiums(bad)


def test_keep_first_with_missing_and_hot_keys(spark):
    rows = [(i, None if i % 3 == 0 else f"p{i % 5}", i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, p string, d int")
    kept = {(r.p, r.d): r.i for r in cleaning.keep_first(df, ["i"], ["p", "d"]).collect()}
    want = {}
    for i, p, d in rows:
        want.setdefault((p, d), i)
    assert kept == want
    assert cleaning.duplicate_count(df, ["p", "d"]).first()[0] == 300 - len(want)
    plan = cleaning.keep_first(df, ["i"], ["p", "d"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_name_collision(spark):
    with pytest.raises(ValueError, match="A_B"):
        cleaning.standardize_names(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_clean_does_not_depend_on_partitions(spark, small):
    raw = damaged_claims(spark, small)
    one = pipeline.clean(raw.repartition(1), ["MANAGER_ID", "ADJUSTER_ID", ROW_POS])
    many = pipeline.clean(raw.repartition(7), ["MANAGER_ID", "ADJUSTER_ID", ROW_POS])
    assert one.columns == list(pipeline.COLUMNS)
    assert one.exceptAll(many).count() == 0 and one.count() == many.count()
    assert quality.null_total(one).first()[0] == 0


def test_mart_keeps_rows_and_takes_trackers(spark, small):
    base = stored(portfolio(spark, small))
    mart = marts.reporting_mart(base, ranges=5)
    assert mart.count() == base.count()
    assert len(mart.columns) == len(base.columns) + 12
    adjusters, contractors = marts.refresh_trackers(base, scratch_path(spark, "trackers"))
    again = marts.reporting_mart(base, adjusters, contractors)
    assert mart.exceptAll(again).count() == 0


def test_mart_does_not_fan_out(spark, small):
    base = portfolio(spark, small)
    suspects = base.filter("PHANTOM_CLAIM_SUSPECT = 1").limit(40)
    one_property = stored(suspects.withColumn("PROPERTY_ID", F.lit("PRP-1")).dropDuplicates(["INCIDENT_DATE"]))
    mart = marts.reporting_mart(one_property)
    assert mart.count() == one_property.count()
    managers = one_property.select("MANAGER_ID").distinct().count()
    assert mart.filter("first_corrupt_claim = 1").count() == managers


def test_walk_agrees_with_recursive_sql(spark, small):
    edges = stored(graph.relationship_edges(portfolio(spark, small)))
    edges.createOrReplaceTempView("edges")
    sql = spark.sql(
        """WITH RECURSIVE w(incident, root, depth, node, node_type, path) AS (
        SELECT incident, from_node, 0, from_node, from_type, from_node FROM edges WHERE from_type = 'manager'
        UNION ALL SELECT w.incident, w.root, w.depth + 1, e.to_node, e.to_type, concat(w.path, ' -> ', e.to_node)
        FROM w JOIN edges e ON w.incident = e.incident AND w.node = e.from_node AND w.node_type = e.from_type
        WHERE w.depth < 3) SELECT * FROM w"""
    )
    walked = graph.walk(edges).select(*sql.columns)
    assert walked.exceptAll(sql).count() == 0 and walked.count() == sql.count()


def test_walk_stops_at_cycles(spark):
    rows = [("c", Decimal(1), "manager", "a", "manager", "b"), ("c", Decimal(1), "manager", "b", "manager", "a")]
    schema = "incident string, payout decimal(18,2), from_type string, from_node string, to_type string, to_node string"
    paths = {r.path for r in graph.walk(spark.createDataFrame(rows, schema), max_depth=6).collect()}
    assert paths == {"a", "b", "a -> b", "b -> a"}


OUTLIERS = {9000 + k: ((-1) ** k * (400.0 + 37 * k), (-1) ** (k // 2) * (300.0 + 53 * k)) for k in range(24)}


def forest_input(spark):
    rows = [(i, float(i % 17), float(i * 31 % 23)) for i in range(2000)] + [(i, *ab) for i, ab in OUTLIERS.items()]
    return spark.createDataFrame(rows, "i bigint, a double, b double")


def test_forest_finds_planted_outliers_under_any_partitioning(spark):
    df = forest_input(spark)
    results = []
    for parts in (1, 2, 7):
        scored = anomaly.isolation_forest(df.repartition(parts), ["i"], ["a", "b"], trees=60)
        results.append({r.i: r.isolation_forest_score for r in scored.collect()})
    assert results[0] == results[1] == results[2]
    ranked = sorted(results[0], key=results[0].get)
    assert set(ranked[: len(OUTLIERS)]) == set(OUTLIERS)
    assert all(-0.5 < s < 0.5 for s in results[0].values())


def test_forest_scores_agree_with_a_walk_down_each_tree(spark):
    df = forest_input(spark)
    matrix = anomaly.feature_matrix(df, ["a", "b"])
    nodes = stored(anomaly.fit_forest(matrix, ["i"], trees=9, sample=32))
    table = {(n.tree, n.node): n for n in nodes.collect()}
    assert {t for t, _ in table} == set(range(9))
    got = {r.i: r.isolation_forest_score for r in anomaly.score(matrix, anomaly.forest_arrays(nodes)).collect()}
    for row in matrix.filter("i % 97 = 0 or i >= 9000").collect():
        lengths = []
        for tree in range(9):
            at = table[tree, 0]
            while at.low != at.node:
                at = table[tree, at.low if (row._f0, row._f1)[at.feature] <= at.threshold else at.high]
            lengths.append(at.path)
        assert got[row.i] == pytest.approx(0.5 - 2 ** (-sum(lengths) / 9 / anomaly.expected_path(32)))


def test_anomaly_tables(stored_claims):
    scored = stored(anomaly.isolation_forest(stored_claims, [ROW_POS], trees=20))
    rate = anomaly.anomaly_rate(scored).first()
    assert rate.anomaly_count == anomaly.anomalies(scored).count() == total(anomaly.anomalies_by_country(scored), "anomalies")
    assert rate.anomaly_rate == pytest.approx(rate.anomaly_count / stored_claims.count())
    document = json.loads(insights(stored_claims, scored).first()[0])
    assert document["isolation_forest"]["anomaly_count"] == rate.anomaly_count
    assert document["daily_rows"] == stored_claims.select("INCIDENT_DATE").distinct().count()
    assert len(document["property_type_analysis"]) == 4


def test_stream_routes_each_claim_once(spark, small):
    rows = portfolio(spark, small).select(*anomaly.ANOMALY_COLUMNS)
    arriving = scratch_path(spark, "arriving")
    rows.repartition(3).write.parquet(arriving)
    rows.limit(500).write.mode("append").parquet(arriving)
    known = stored(rows)
    forest = anomaly.forest_arrays(anomaly.fit_forest(anomaly.feature_matrix(known), ["PROPERTY_ID", "INCIDENT_DATE"], trees=20))
    medians = exact_medians(known, anomaly.FEATURES)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(arriving)
    queue = screening.review_queue(stream, forest, medians)
    sink = scratch_path(spark, "review")
    screening.start_review(queue, sink, scratch_path(spark, "state")).awaitTermination()
    batch = anomaly.anomalies(anomaly.score(anomaly.feature_matrix(known), forest))
    got = spark.read.schema(queue.schema).parquet(sink)
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count() > 0


def test_partitioned_write_replaces_and_prunes(spark, stored_claims):
    path = scratch_path(spark, "parts")
    rows = stored_claims.select("PROPERTY_ID", "COUNTRY_CODE")
    for _ in range(2):
        files.write_partitioned(rows, path)
    read = files.read_partitioned(spark, path)
    assert read.count() == rows.count()
    plan = read.filter("COUNTRY_CODE = 'CA'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(COUNTRY_CODE" in plan


def test_csv_keeps_awkward_text(spark):
    rows = [('{"a": "b, c"}', " x "), (None, "\\"), ('""', None)]
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([*rows, ("empty", "")], "a string, b string")
    files.write_csv(df, path)
    read = spark.read.schema("a string, b string").options(**files.CSV_FORM).csv(path)
    # Empty text reads as missing.
    assert sorted(map(str, map(tuple, read.collect()))) == sorted(map(str, [*rows, ("empty", None)]))


def test_mart_coercion(spark):
    df = spark.createDataFrame([("1.5", "2024-01-02"), ("n/a", "soon"), (None, None)], "PAYOUT_AUTHORIZED string, INCIDENT_DATE string")
    assert [tuple(r) for r in files.coerce_mart(df).collect()] == [(1.5, datetime(2024, 1, 2)), (None, None), (None, None)]


def test_table_load_replaces_and_nulls_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "i int, r double")
    for _ in range(2):
        loaded = files.load_table(df, "loaded_claims")
    assert sorted(tuple(r) for r in loaded.collect()) == [(1, None), (2, 0.5)]
    spark.sql("DROP TABLE loaded_claims")


def test_types_listing(stored_claims):
    listed = {r.column_name: r.data_type for r in quality.column_types(stored_claims).collect()}
    assert listed["VALUATION_USD"] == "decimal(18,6)" and listed["INCIDENT_DATE"] == "timestamp_ntz"


def test_spearman_beyond_one_task(stored_claims):
    plain = stats.spearman(stored_claims).first()
    ranged = stats.spearman(stored_claims, ranges=5).first()
    assert plain.spearman_rho == pytest.approx(ranged.spearman_rho, abs=1e-12)
    assert plain.observations == ranged.observations


def test_repeat_claims_over_ranges(stored_claims):
    one = windows.repeat_claims(stored_claims, [ROW_POS], ranges=1)
    many = windows.repeat_claims(stored_claims, [ROW_POS], ranges=9)
    assert one.exceptAll(many).count() == 0 and one.count() == many.count()
    assert one.filter("next_incident_date < INCIDENT_DATE").count() == 0


def test_degenerate_statistics(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    for test in (stats.pearson, stats.spearman):
        row = test(flat, "x", "y").first()
        assert row[0] is None and row[2] is None and row[1] == 3
    two = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "x double, y double")
    for test in (stats.pearson, stats.spearman):
        assert test(two, "x", "y").first()[2] == 1.0
    assert stats.pearson(flat.limit(0), "x", "y").first().pearson_r is None
    rows = spark.createDataFrame([("Apex Restoration", 3)] * 3 + [("Global Rebuild", 3)] * 2, "DECODED_CONTRACTOR string, PAYOUT_AUTHORIZED int")
    result = stats.welch_test(rows).first()
    assert result.t_statistic is None and result.two_sided_p_value is None and result.significant_at_0_05 is None


def test_trees_draw_from_all_rows(spark):
    from claimlens.operators import anomaly

    matrix = spark.range(300_000).select("id", F.col("id").cast("double").alias("_f0"))
    drawn = anomaly.tree_samples(matrix, ["id"], trees=1, sample=100_000)
    assert drawn.count() == 100_000 and drawn.select("_f0").distinct().count() == 100_000
    small = anomaly.tree_samples(matrix.limit(50), ["id"], trees=3, sample=64).groupBy("tree").count().collect()
    assert sorted(r["count"] for r in small) == [50, 50, 50]


def test_raw_scan_follows_the_header_and_the_files(spark, tmp_path):
    from claimlens.sources import files
    from claimlens.sources.tables import ROW_POS

    names = ["Manager_ID", "Incident Date", "property-id", "Adjuster_ID", "Property_Type", "Currency_Code", "Square_Footage", "Valuation_Local"]
    names += ["Current_Premium_Local", "Base_Premium_USD", "Insurance_Metadata_JSON", "Country_Code"]

    def lines(managers):
        return "\n".join([",".join(names), *[f"{m},2022-01-06,PRP-1,A,Single,USD,1500.0,1000.456,x{m},12,,US" for m in managers]]) + "\n"

    (tmp_path / "a.csv").write_text(lines(["M1", "M2"]))
    (tmp_path / "b.csv").write_text(lines([f"N{k}" for k in range(500)]))
    text = files.read_raw_text(spark, str(tmp_path))
    rows = files.type_raw(text).orderBy(ROW_POS).collect()
    assert [r.MANAGER_ID for r in rows] == ["M1", "M2", *[f"N{k}" for k in range(500)]]
    assert (float(rows[0].VALUATION_LOCAL), float(rows[0].SQUARE_FOOTAGE), rows[0].CURRENT_PREMIUM_LOCAL) == (1000.456, 1500.0, None)
    lost = {r.column_name: r.unparsed for r in files.unparsed(text).collect()}
    assert lost["CURRENT_PREMIUM_LOCAL"] == 502 and lost["VALUATION_LOCAL"] == 0
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "c.csv").write_text("Manager_ID,Country_Code\nM,US\n")
    with pytest.raises(ValueError, match="INCIDENT_DATE"):
        files.read_raw_text(spark, str(tmp_path / "only"))
