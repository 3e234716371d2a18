"""Repair of raw claims: dates, metadata fields, contractor tokens, duplicates and missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.ascii85 import decode_ascii85
from claimlens.functions.parsing import (
    epoch_micros,
    from_epoch_micros,
    number_field,
    parse_mixed_date,
    standard_name,
    strip_all,
    text_field,
)
from claimlens.operators.ordered import ascending, attach_lookup, exact_medians, stored_lookup


def standardize_names(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Columns in upper case with underscores; two names becoming one is an error."""
    names = [c if c in keep else standard_name(c) for c in df.columns]
    if len(set(names)) != len(names):
        clashes = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"column names collide after standardizing: {clashes}")
    return df.toDF(*names)


def parse_dates(df: DataFrame, column: str = "INCIDENT_DATE") -> DataFrame:
    return df.withColumn(column, parse_mixed_date(F.col(column).cast("string")))


def median_date(df: DataFrame, column: str = "INCIDENT_DATE"):
    """Exact median of the dates as a literal column, null when there are none."""
    micros = df.select(epoch_micros(F.col(column)).alias("micros"))
    middle = exact_medians(micros, ["micros"])["micros"]
    if middle is None:
        return F.lit(None).cast("timestamp_ntz")
    return from_epoch_micros(F.lit(int(middle)))


def impute_dates(df: DataFrame, column: str = "INCIDENT_DATE") -> DataFrame:
    """Missing dates become the median date."""
    return df.withColumn(column, F.coalesce(F.col(column), median_date(df, column)))


def add_date_parts(df: DataFrame, column: str = "INCIDENT_DATE") -> DataFrame:
    date = F.col(column)
    return df.withColumns({"YEAR": F.year(date), "MONTH": F.month(date), "QUARTER": F.quarter(date)})


def extract_metadata(df: DataFrame, column: str = "INSURANCE_METADATA_JSON") -> DataFrame:
    """The four metadata fields, read from the text in one projection."""
    text = F.col(column)
    return df.withColumns(
        {
            "INCIDENT_CLASSIFICATION": text_field(text, "incident_classification"),
            "PAYOUT_AUTHORIZED": number_field(text, "payout_authorized"),
            "CONTRACTOR_A85": text_field(text, "contractor_a85"),
            "ADJUSTER_GRATUITY": number_field(text, "adjuster_gratuity"),
        }
    )


def decode_contractors(
    df: DataFrame, token: str = "CONTRACTOR_A85", out: str = "DECODED_CONTRACTOR"
) -> DataFrame:
    """Decode each distinct token once and join the names back.

    Rows without a token match nothing; they join under keys of their own, one for each input split, and so do not
    meet in one partition.
    """
    tokens = df.select(token).filter(F.col(token).isNotNull()).distinct()
    names = tokens.select(F.concat(F.lit("="), token).alias("_token"), decode_ascii85(F.col(token)).alias(out))
    own = F.coalesce(F.concat(F.lit("="), token), F.concat(F.lit("-"), F.spark_partition_id().cast("string")))
    return df.withColumn("_token", own).join(stored_lookup(names), "_token", "left").select(*df.columns, out)


def unknown_currencies(df: DataFrame, rate: str = "EXCHANGE_RATE_USD") -> DataFrame:
    """Number of rows whose currency has no rate."""
    return df.agg(F.count_if(F.col(rate).isNull()).alias("unknown_currency_rows"))


def missing_dates(raw: DataFrame, column: str = "INCIDENT_DATE") -> DataFrame:
    """Missing dates after parsing, blank and unreadable ones apart, and after imputation."""
    text = F.col(column).cast("string")
    parsed = parse_dates(raw.select(column, (F.coalesce(strip_all(text), F.lit("")) == "").alias("_blank")), column)
    filled = F.coalesce(F.col(column), median_date(parsed, column))
    gone = F.col(column).isNull()
    return parsed.agg(
        F.count_if(gone).alias("missing_before"),
        F.count_if(gone & F.col("_blank")).alias("blank_before"),
        F.count_if(gone & ~F.col("_blank")).alias("unreadable_before"),
        F.count_if(filled.isNull()).alias("missing_after"),
    )


def duplicate_count(df: DataFrame, keys: Sequence[str] = ("PROPERTY_ID", "INCIDENT_DATE")) -> DataFrame:
    """Rows a keep-first deduplication would drop; missing keys equal each other."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def keep_first(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = ("PROPERTY_ID", "INCIDENT_DATE"),
) -> DataFrame:
    """First row of each key in ``order``.

    Spark limits each key to its first row before the shuffle as well, so a hot key sends one row per task.
    """
    first = Window.partitionBy(*keys).orderBy(*ascending(*order))
    return df.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1).drop("_rn")


def finite(column: Column) -> Column:
    """Null for NaN and infinities."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), column)


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def impute_medians(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers become the exact median of their column, found for all columns in one pass.

    Only columns that miss a value are ranked.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    gap = {c: F.col(c).isNull() | F.isnan(c) if c in fractional else F.col(c).isNull() for c in columns}
    counts = df.agg(*[F.count_if(gap[c]).alias(c) for c in columns]).first()
    lacking = [c for c in columns if counts[c]]
    medians = exact_medians(df, lacking) if lacking else {}
    types = {f.name: f.dataType for f in df.schema.fields}
    filled = {
        c: F.when(gap[c], F.lit(medians[c]).cast(types[c])).otherwise(F.col(c))
        for c in lacking
        if medians[c] is not None
    }
    return df.withColumns(filled) if filled else df


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def fill_text(df: DataFrame, columns: Sequence[str] | None = None, value: str = "Unknown") -> DataFrame:
    return df.fillna(value, subset=list(columns) if columns is not None else text_columns(df))


def strip_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Trim every text column; runs after filling, so text of only whitespace becomes ''."""
    names = list(columns) if columns is not None else text_columns(df)
    return df.withColumns({c: strip_all(F.col(c)) for c in names})


def backfill(df: DataFrame, lookup: DataFrame, key: str = "PROPERTY_ID", column: str = "COUNTRY_CODE") -> DataFrame:
    """Set a column from a keyed lookup where the key is listed; the greatest value wins a conflict."""
    found = lookup.filter(F.col(column).isNotNull()).groupBy(key).agg(F.max(column).alias("_found"))
    joined = attach_lookup(df, found.filter(F.col(key).isNotNull()), [key])
    return joined.withColumn(column, F.coalesce("_found", column)).drop("_found").select(*df.columns)
