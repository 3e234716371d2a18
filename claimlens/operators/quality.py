"""Checks and profiles of a table, each as a small result table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.operators.cleaning import numeric_columns
from claimlens.operators.ordered import attach_lookup, exact_quantiles, stored_by_column

PREMIUMS = ("CURRENT_PREMIUM_LOCAL", "BASE_PREMIUM_USD", "CURRENT_PREMIUM_USD")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def completeness(df: DataFrame, column: str = "COUNTRY_CODE") -> DataFrame:
    """Rows, rows with a value and distinct values of a column."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(column).alias("filled_rows"),
        F.countDistinct(column).alias("distinct_values"),
    )


def _by_column(df: DataFrame, measures: dict[str, Column], label: str, value: str) -> DataFrame:
    """One aggregate per column name, turned into one row per column."""
    wide = df.agg(*[m.alias(c) for c, m in measures.items()])
    return wide.unpivot([], list(measures), label, value)


def premium_violations(df: DataFrame, columns: Sequence[str] = PREMIUMS) -> DataFrame:
    """Rows breaking the rule 'premium is present and not negative', per premium column."""
    broken = {c: F.count_if(F.col(c).isNull() | (F.col(c) < 0)) for c in columns}
    return _by_column(df, broken, "rule_column", "violations")


def require_premiums(df: DataFrame, columns: Sequence[str] = PREMIUMS) -> DataFrame:
    """The input unchanged; raises when a premium rule is broken."""
    broken = premium_violations(df, columns).filter(F.col("violations") > 0).collect()
    if broken:
        raise ValueError(f"negative or missing premiums: { {r[0]: r[1] for r in broken} }")
    return df


def null_counts(df: DataFrame) -> DataFrame:
    """Columns that miss values, most first."""
    missing = {c: F.count_if(F.col(c).isNull()) for c in df.columns}
    counts = _by_column(df, missing, "column_name", "null_count")
    return counts.filter(F.col("null_count") > 0).orderBy(F.col("null_count").desc(), "column_name")


def null_total(df: DataFrame) -> DataFrame:
    """Missing values over all columns."""
    return df.agg(sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).alias("total_nulls"))


def column_types(df: DataFrame) -> DataFrame:
    """Name, type and position of each column."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    schema = "position int, column_name string, data_type string, nullable boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 3) -> DataFrame:
    """Per column: counts, distinct values, extremes, moments, quartiles and the most frequent values.

    The rows are stored by column. One aggregate gives counts, extremes and moments of all columns; distinct and
    frequent values come column by column, each reading its own column only, and a frequent value is collapsed before
    the shuffle. Every part has one row per column, or ``top``.
    """
    names = [c for c in (columns or df.columns) if not isinstance(df.schema[c].dataType, T.StructType)]
    kept = stored_by_column(df.select(*names))
    numbers = numeric_columns(kept)
    facts, distinct, frequent = [], [], []
    for c in names:
        text = F.col(c).cast("string")
        number = F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")
        facts.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(F.col(c).isNull()).alias("null_count"),
                F.min(text).alias("min_text"),
                F.max(text).alias("max_text"),
                F.min(number).alias("min_number"),
                F.max(number).alias("max_number"),
                F.avg(number).alias("mean"),
                *([F.stddev_samp(number).alias("stddev")] if numbers else []),
            )
        )
        counts = kept.groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("value").isNotNull())
        distinct.append(counts.agg(F.count(F.lit(1)).alias("distinct_count")).select(F.lit(c).alias("column_name"), "distinct_count"))
        frequent.append(counts.orderBy(F.col("n").desc(), "value").limit(top).select(F.lit(c).alias("column_name"), "n", "value"))
    result = kept.agg(F.array(*facts).alias("_facts")).select(F.inline("_facts"))
    entry = F.struct((-F.col("n")).alias("n"), "value")
    common = (
        reduce(DataFrame.unionByName, frequent)
        .groupBy("column_name")
        .agg(F.sort_array(F.collect_list(entry)).alias("_top"))
        .select(
            "column_name",
            F.array_join(
                F.transform("_top", lambda t: F.concat(t["value"], F.lit(" ("), (-t["n"]).cast("string"), F.lit(")"))),
                "; ",
            ).alias("top_values"),
        )
    )
    result = attach_lookup(result, reduce(DataFrame.unionByName, distinct), ["column_name"], bounded=True)
    result = attach_lookup(result, common, ["column_name"], bounded=True)
    if numbers:
        quartiles = exact_quantiles(kept, numbers, [0.25, 0.5, 0.75]).select(
            F.col("column").alias("column_name"),
            *[F.col("quantiles")[i].alias(q) for i, q in enumerate(("q1", "median", "q3"))],
        )
        result = attach_lookup(result, quartiles, ["column_name"], bounded=True)
    return result
