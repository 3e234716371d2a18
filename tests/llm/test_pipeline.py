"""Every stage of the corpus pipeline against its rule, on the rows the stage before kept."""

from __future__ import annotations

import sys
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from claimlens.llm.tables import stored, table

sys.path.insert(0, str(Path(__file__).parent))
from test_text_operators import brute_components, brute_hits, brute_lines, check_pieces  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, small):
    """The rows before the first stage and after each one."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    last = docs.limit(1).withColumns({"doc_id": F.lit(10**9).cast("long"), "text": F.lit("12 34 !!")})
    docs = docs.union(last.select(*docs.columns))
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(stored(stage(spark, made[-1], small), name))
    return made


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_only_text_without_language_goes(stages):
    assert [k for k, _ in texts(stages[0])][:-1] == [k for k, _ in texts(stages[1])]


def test_lines(stages):
    want = brute_lines(texts(stages[1]))
    assert texts(stages[2]) == sorted((k, t) for k, (t, _) in want.items())
    assert stages[2].where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_duplicates(stages):
    want = brute_components(texts(stages[2]), 5)
    assert [k for k, _ in texts(stages[3])] == sorted(k for k, (_, c) in want.items() if c == k)


def test_contaminated(spark, small, stages):
    tests = [(r.item_id, r.text) for r in table(spark, small, "benchmark", "item_id", "text").collect()]
    want = brute_hits(texts(stages[3]), tests)
    assert [k for k, _ in texts(stages[4])] == sorted(k for k, v in want.items() if not v[1])


def test_packed(stages):
    check_pieces(stages[5].collect(), texts(stages[4]))


def test_run_equals_its_stages(spark, small):
    rows = corpus_pipeline.run(spark, small).select("doc_id", "length").collect()
    assert rows and all(r.length > 0 for r in rows)
