"""The three stages end to end, from a raw CSV file."""

import json

from claimlens.operators.cleaning import standardize_names
from claimlens.plans import jobs, pipeline
from claimlens.session import scratch_path
from claimlens.sources import files
from claimlens.sources.tables import ROW_POS, damaged_claims


def test_stages(spark, small):
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "out")
    damaged = damaged_claims(spark, small)
    files.write_csv(damaged.drop(ROW_POS), raw)
    claims = jobs.prepare(spark, raw, out)
    assert claims.columns == list(pipeline.COLUMNS)
    keys = standardize_names(damaged, keep=[ROW_POS])
    assert 0 < claims.count() <= keys.count()
    assert claims.select("PROPERTY_ID").distinct().count() == pipeline.strip_text(keys.select("PROPERTY_ID")).distinct().count()
    mart = jobs.relate(spark, out)
    # A country's folder is read back for every row, and no row is lost or repeated on the way.
    assert mart.count() == claims.count() and len(mart.columns) == 40
    document = json.loads(jobs.diagnose(spark, out).first()[0])
    assert document["claim_payout_descriptive_statistics"]["count"] == mart.count()
    payouts = spark.read.text(f"{out}/manager_payouts").count()
    assert payouts == claims.select("MANAGER_ID").distinct().count()

    jobs.register_views(claims, mart)
    jobs.materialize_trackers(claims, out)
    sql = spark.sql(
        """SELECT p.ADJUSTER_ID, sum(p.PAYOUT_AUTHORIZED) AS paid, max(t.total_authorized_payouts) AS tracked,
        max(m.total_authorized_payouts) AS stored, max(v.adjuster_total_authorized_payouts) AS in_mart
        FROM reit_portfolio p JOIN vw_adjuster_tracker t ON p.ADJUSTER_ID = t.adjuster_id
        JOIN mv_adjuster_tracker m ON p.ADJUSTER_ID = m.adjuster_id
        JOIN (SELECT DISTINCT ADJUSTER_ID, adjuster_total_authorized_payouts FROM vw_powerbi_dataset) v
        ON p.ADJUSTER_ID = v.ADJUSTER_ID GROUP BY p.ADJUSTER_ID"""
    ).collect()
    assert sql and all(r.paid == r.tracked == r.stored == r.in_mart for r in sql)
