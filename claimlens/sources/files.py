"""Readers and writers: raw and mart CSV, partitioned Parquet, tables and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.parsing import standard_name, strip_all
from claimlens.operators.cleaning import backfill
from claimlens.operators.ordered import stored_by_column
from claimlens.sources.tables import ROW_POS

# The raw file's columns, by standard name. Text stays text until the cleaning operators parse it.
RAW_SCHEMA = (
    "PROPERTY_ID string, INCIDENT_DATE string, MANAGER_ID string, ADJUSTER_ID string, PROPERTY_TYPE string, "
    "CURRENCY_CODE string, SQUARE_FOOTAGE decimal(18,4), VALUATION_LOCAL decimal(22,6), "
    "CURRENT_PREMIUM_LOCAL decimal(22,6), BASE_PREMIUM_USD decimal(22,6), INSURANCE_METADATA_JSON string, "
    "COUNTRY_CODE string"
)
# The mart's amounts.
MART_NUMBERS = (
    "PAYOUT_AUTHORIZED",
    "VALUATION_USD",
    "CURRENT_PREMIUM_USD",
    "PREMIUM_SPIKE_USD",
    "ADJUSTER_GRATUITY",
    "TOTAL_FINANCIAL_DAMAGE_USD",
    "PAYOUT_TO_VALUE_RATIO",
    "ADJUSTER_KICKBACK_RATIO",
)
# Quotes are doubled inside quoted text, which the metadata column needs.
CSV_FORM = {"header": "true", "quote": '"', "escape": '"'}
# Written text keeps its own spaces.
CSV_TEXT = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_raw_text(spark: SparkSession, path: str, schema: str = RAW_SCHEMA, multi_line: bool = False) -> DataFrame:
    """The raw file's columns as text under their standard names, with each row's place in file order.

    Columns are found by the header, wherever they stand; a missing or doubled one is an error, as is a file whose
    header differs from the first one's. A place is the file, the offset of its split and the row's number there,
    so files follow each other by path. Empty text reads as missing. ``multi_line`` allows line breaks inside
    quotes, at the price of reading each file in one task.
    """
    form = {**CSV_FORM, "multiLine": str(multi_line).lower()}
    header = spark.read.options(**form).csv(path).columns
    names = [standard_name(c) for c in header]
    wanted = T.StructType.fromDDL(schema).fieldNames()
    absent, doubled = [c for c in wanted if c not in names], [c for c in wanted if names.count(c) > 1]
    if absent or doubled:
        raise ValueError(f"raw columns missing: {absent}, more than once: {doubled}")
    read = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(read).options(**form, enforceSchema="false").csv(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    found = dict(zip(names, header))
    return raw.select(*[F.col(f"`{found[c]}`").alias(c) for c in wanted], place.alias(ROW_POS))


def type_raw(text: DataFrame, schema: str = RAW_SCHEMA) -> DataFrame:
    """Raw text columns in their types; what does not parse becomes null."""
    fields = T.StructType.fromDDL(schema).fields
    typed = {f.name: strip_all(F.col(f.name)).try_cast(f.dataType) for f in fields if f.dataType != T.StringType()}
    return text.withColumns(typed)


def unparsed(text: DataFrame, schema: str = RAW_SCHEMA) -> DataFrame:
    """Per typed column the values that are there but do not parse."""
    fields = [f for f in T.StructType.fromDDL(schema).fields if f.dataType != T.StringType()]

    def lost(f: T.StructField):
        value = strip_all(F.col(f.name))
        return F.count_if((value != "") & value.try_cast(f.dataType).isNull()).alias(f.name)

    return text.agg(*[lost(f) for f in fields]).unpivot([], [f.name for f in fields], "column_name", "unparsed")


def read_raw_csv(spark: SparkSession, path: str, schema: str = RAW_SCHEMA, multi_line: bool = False) -> DataFrame:
    """Raw claims by header, typed, with their place in file order."""
    return type_raw(read_raw_text(spark, path, schema, multi_line), schema)


def write_csv(df: DataFrame, path: str, quote_all: bool = False, compression: str = "none") -> None:
    """CSV with a header in each file. Compressed files are read whole, one in a task each."""
    form = {**CSV_FORM, **CSV_TEXT, "quoteAll": str(quote_all).lower(), "compression": compression}
    df.write.mode("overwrite").options(**form).csv(path)


def read_mart_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The exported mart, amounts and date coerced; text that does not parse becomes null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return coerce_mart(spark.read.schema(schema).options(**CSV_FORM).csv(path))


def coerce_mart(df: DataFrame, numbers: Sequence[str] = MART_NUMBERS, date: str = "INCIDENT_DATE") -> DataFrame:
    typed = {c: F.col(c).try_cast("double") for c in numbers if c in df.columns}
    if date in df.columns:
        typed[date] = F.col(date).try_cast("timestamp_ntz")
    return df.withColumns(typed)


def write_partitioned(df: DataFrame, path: str, column: str = "COUNTRY_CODE") -> None:
    """Parquet by country, replacing what was there. Rows are written where they lie, so a country holding
    much of the table is written by many tasks."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def read_partitioned(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All partitions, the partition column recovered from the folder names; ``columns`` prunes the scan."""
    df = spark.read.option("basePath", path).parquet(path)
    return df.select(*columns) if columns else df


def backfill_partitions(spark: SparkSession, path: str, lookup: DataFrame, key: str = "PROPERTY_ID", column: str = "COUNTRY_CODE") -> list[str | None]:
    """Set the partition column of a partitioned table from a keyed lookup, in place, and return the partitions rewritten.

    The rows are those of :func:`backfill` over the whole table: a listed key takes the greatest value listed for it, any
    other row keeps its own. A first pass over the key and the folder names alone finds the partitions that rows leave or
    enter; only these are read whole and overwritten, and one that is left empty is removed. All others keep their files.
    The rows to write are stored before, so a run that fails while it writes loses none of them and can be repeated.
    """
    rows = read_partitioned(spark, path)
    moved = backfill(rows.select(key, F.col(column).alias("_old"), column), lookup, key, column).filter(~F.col("_old").eqNullSafe(F.col(column)))
    # At most one row per partition.
    values = F.array(F.struct(F.col("_old").alias("value")), F.struct(F.col(column).alias("value")))
    touched = [r.value for r in moved.select(F.inline(values)).distinct().collect()]
    if not touched:
        return []

    def among(name: str) -> Column:
        listed = F.col(name).isin([v for v in touched if v is not None])
        return F.coalesce(listed, F.lit(None in touched))

    # A row that ends in one of these partitions began in one of them.
    filled = backfill(rows.filter(among(column)), lookup, key, column)
    ready = stored_by_column(filled)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    left = {r[0] for r in ready.select(column).distinct().collect()}
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for value in touched:
        if value not in left:
            folder = paths(f"{path}/{column}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(touched, key=lambda v: (v is None, v))


def write_clustered(
    df: DataFrame,
    path: str,
    keys: Sequence[str] = ("ADJUSTER_ID", "INCIDENT_DATE"),
    spread: Sequence[str] = (),
) -> None:
    """Parquet sorted by adjuster and date, so filters on them skip row groups.

    A hot adjuster splits by date; ``spread``, such as the row position, also splits rows equal in both.
    """
    df.repartitionByRange(*keys, *spread).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df


def load_table(df: DataFrame, name: str) -> DataFrame:
    """Store as a table with NaN as null, replacing an earlier load."""
    nan_to_null(df).write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def as_json_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """``{key: value}`` as one JSON object per row; rows without a key are left out."""
    pair = F.create_map(F.col(key), F.col(value))
    return df.filter(F.col(key).isNotNull()).select(F.to_json(pair).alias("json"))
