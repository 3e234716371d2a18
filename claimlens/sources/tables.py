"""Claims in the shape the operators expect, derived from the order tables of a data folder."""

from __future__ import annotations

from base64 import a85encode
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.risk import add_risk_features
from claimlens.operators.cleaning import keep_first

# What the codes of the order tables stand for.
COUNTRIES = ("US", "CA", "UK", "DE", "FR")
CURRENCIES = ("USD", "CAD", "GBP", "EUR", "EUR")
PROPERTY_TYPES = ("Commercial", "Multi-Family", "Single Family", "Industrial")
CONTRACTORS = {
    "ECONOMY": "Standard_Vendor",
    "LARGE": "Apex Restoration",
    "MEDIUM": "Global Rebuild",
    "PROMO": "Vanguard Restorations",
    "SMALL": "Shadow Contracting LLC",
}

# The columns read of each order table. A given schema saves the job that would infer it.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "part": "p_partkey bigint, p_type string, p_size int, p_retailprice double",
}

ROW_POS = "ROW_POS"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def with_row_position(df: DataFrame) -> DataFrame:
    """Add the position of each row in its Parquet file: stable under any split, retry or partitioning."""
    position = F.struct(
        F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row")
    )
    return df.withColumn(ROW_POS, position)


def _pick(index: Column, names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in names])[index.cast("int")]


def _owners(spark: SparkSession, folder: str) -> DataFrame:
    """What a claim takes from its order: the manager's number and the region. Joined among themselves, so that the
    claims, which are many more, move once for all of it."""
    return (
        read_table(spark, folder, "orders")
        .join(read_table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", (F.col("o_custkey") % 200).alias("_manager"), F.col("n_regionkey").alias("_region"))
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """The line items as small numbers, which is how they move: text and amounts are spelt out after the joins."""
    returned = F.col("l_returnflag") == "R"
    return with_row_position(read_table(spark, folder, "lineitem")).select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_shipdate",
        F.col("l_quantity").cast("decimal(6,0)").alias("_quantity"),
        F.abs("l_discount").cast("decimal(4,2)").alias("_discount"),
        F.when(returned, F.col("l_extendedprice").cast("decimal(18,2)")).otherwise(0).cast("decimal(18,2)").alias("_payout"),
        F.when(returned, F.abs("l_tax").cast("decimal(4,2)")).otherwise(0).cast("decimal(4,2)").alias("_tax"),
        (F.col("l_linestatus") == "F").alias("_fire"),
        ROW_POS,
    )


def _claim_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Typed claims along with the line, order and part numbers the damaged form and the portfolio are keyed on."""
    joined = (
        _lines(spark, folder)
        .join(_owners(spark, folder), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read_table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    base_premium = (1000 + 10 * F.col("_quantity")).cast("decimal(18,2)")
    contractors = F.create_map(*[F.lit(v) for pair in CONTRACTORS.items() for v in pair])
    return joined.select(
        F.format_string("PRP-%07d", "l_partkey").alias("PROPERTY_ID"),
        F.col("l_shipdate").alias("INCIDENT_DATE"),
        F.concat(F.lit("MGR-"), (100 + F.col("_manager")).cast("string")).alias("MANAGER_ID"),
        F.concat(F.lit("ADJ-"), (1000 + F.col("l_suppkey")).cast("string")).alias("ADJUSTER_ID"),
        _pick(F.col("p_size") % 4, PROPERTY_TYPES).alias("PROPERTY_TYPE"),
        _pick(F.col("_region"), CURRENCIES).alias("CURRENCY_CODE"),
        (F.col("p_size") * 100).alias("SQUARE_FOOTAGE"),
        (F.col("p_retailprice").cast("decimal(10,2)") * F.col("p_size").cast("decimal(4,0)") * 300)
        .cast("decimal(18,2)")
        .alias("VALUATION_LOCAL"),
        (base_premium * (1 + 40 * F.col("_discount"))).cast("decimal(18,2)").alias("CURRENT_PREMIUM_LOCAL"),
        base_premium.alias("BASE_PREMIUM_USD"),
        _pick(F.col("_region"), COUNTRIES).alias("COUNTRY_CODE"),
        F.when(F.col("_fire"), "Structural Fire").otherwise("Water Damage").alias("INCIDENT_CLASSIFICATION"),
        F.col("_payout").alias("PAYOUT_AUTHORIZED"),
        # Tax and payout are 0 where nothing was returned.
        (F.col("_payout").cast("decimal(10,2)") * F.col("_tax")).cast("decimal(18,2)").alias("ADJUSTER_GRATUITY"),
        contractors[F.split("p_type", " ")[0]].alias("DECODED_CONTRACTOR"),
        ROW_POS,
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )


def typed_claims(spark: SparkSession, folder: str) -> DataFrame:
    """One typed claim per line item; the contractor may be missing."""
    return _claim_rows(spark, folder).drop("l_orderkey", "l_linenumber", "l_partkey")


def with_measures(typed: DataFrame) -> DataFrame:
    """The date parts, the risk measures and missing contractors as 'Unknown'."""
    return (
        typed.fillna("Unknown", subset=["DECODED_CONTRACTOR"])
        .withColumns(
            {
                "YEAR": F.year("INCIDENT_DATE"),
                "MONTH": F.month("INCIDENT_DATE"),
                "QUARTER": F.quarter("INCIDENT_DATE"),
            }
        )
        .transform(add_risk_features)
    )


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Typed claims with the date parts, the risk measures and missing contractors as 'Unknown'."""
    return typed_claims(spark, folder).transform(with_measures)


def first_typed_claims(spark: SparkSession, folder: str, order: Sequence[str]) -> DataFrame:
    """The first of :func:`typed_claims` in ``order`` for each property and date.

    A property is a part, so its claims are looked for by the part's number: after a shuffled join with the parts they
    lie together already and need not move again.
    """
    rows = _claim_rows(spark, folder).drop("l_orderkey", "l_linenumber")
    return keep_first(rows, order, ["l_partkey", "INCIDENT_DATE"]).drop("l_partkey")


def first_claims(spark: SparkSession, folder: str, order: Sequence[str]) -> DataFrame:
    """The same with measures, which are added to the first claims alone."""
    return first_typed_claims(spark, folder, order).transform(with_measures)


def damaged_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The same claims as raw text: mixed dates, broken JSON, encoded contractors and untidy names."""
    rows = _claim_rows(spark, folder)
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    seconds = F.unix_date(F.col("INCIDENT_DATE").cast("date")).cast("bigint") * 86400
    date_text = (
        F.when(order % 997 == 0, F.lit(None))
        .when(order % 991 == 1, "0xZZ")
        .when(line % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex(seconds))))
        .otherwise(F.col("INCIDENT_DATE").cast("date").cast("string"))
    )
    tokens = {name: a85encode(name.encode()).decode() for name in CONTRACTORS.values()}
    token = F.create_map(*[F.lit(v) for pair in tokens.items() for v in pair])[F.col("DECODED_CONTRACTOR")]
    vendor = F.when(token.isNotNull(), F.concat(F.lit('"contractor_a85": "'), token, F.lit('", '))).otherwise("")
    metadata = F.concat(
        F.lit('{"incident_classification": "'),
        F.col("INCIDENT_CLASSIFICATION"),
        F.lit('", "payout_authorized": '),
        F.col("PAYOUT_AUTHORIZED").cast("string"),
        F.when(line % 3 == 0, ', "payout_routing" {').otherwise(', "payout_routing": {'),
        vendor,
        F.lit('"adjuster_gratuity": '),
        F.col("ADJUSTER_GRATUITY").cast("string"),
        F.lit("}}"),
    )

    def untidy(name: str) -> Column:
        return F.when(line % 5 == 0, F.concat(F.lit(" \t"), F.col(name), F.lit("  "))).otherwise(F.col(name))

    return rows.select(
        untidy("PROPERTY_ID").alias("Property ID"),
        date_text.alias("incident-date"),
        untidy("MANAGER_ID").alias("Manager_ID"),
        untidy("ADJUSTER_ID").alias("Adjuster_ID"),
        untidy("PROPERTY_TYPE").alias("Property Type"),
        F.when(order % 983 == 2, "XXX").otherwise(F.col("CURRENCY_CODE")).alias("Currency_Code"),
        F.col("SQUARE_FOOTAGE").alias("Square_Footage"),
        F.col("VALUATION_LOCAL").alias("Valuation_Local"),
        F.col("CURRENT_PREMIUM_LOCAL").alias("Current_Premium_Local"),
        F.col("BASE_PREMIUM_USD").alias("Base_Premium_USD"),
        F.when(order % 499 != 3, metadata).alias("Insurance_Metadata_JSON"),
        untidy("COUNTRY_CODE").alias("_Country-Code_"),
        ROW_POS,
    )
