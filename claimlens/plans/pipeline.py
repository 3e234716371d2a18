"""The cleaning pipeline: raw text claims in, one typed row per property and date out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from claimlens.functions.parsing import standard_name
from claimlens.functions.risk import add_risk_features
from claimlens.operators.cleaning import (
    add_date_parts,
    decode_contractors,
    extract_metadata,
    fill_text,
    impute_dates,
    impute_medians,
    keep_first,
    parse_dates,
    standardize_names,
    strip_text,
)
from claimlens.operators.ordered import stored_by_column
from claimlens.sources.tables import ROW_POS

# Columns of the cleaned table, in the order of the source followed by the derived ones.
COLUMNS = (
    "PROPERTY_ID",
    "INCIDENT_DATE",
    "MANAGER_ID",
    "ADJUSTER_ID",
    "PROPERTY_TYPE",
    "CURRENCY_CODE",
    "SQUARE_FOOTAGE",
    "VALUATION_LOCAL",
    "CURRENT_PREMIUM_LOCAL",
    "BASE_PREMIUM_USD",
    "INSURANCE_METADATA_JSON",
    "YEAR",
    "MONTH",
    "QUARTER",
    "INCIDENT_CLASSIFICATION",
    "PAYOUT_AUTHORIZED",
    "CONTRACTOR_A85",
    "ADJUSTER_GRATUITY",
    "DECODED_CONTRACTOR",
    "EXCHANGE_RATE_USD",
    "VALUATION_USD",
    "CURRENT_PREMIUM_USD",
    "PREMIUM_SPIKE_USD",
    "PAYOUT_TO_VALUE_RATIO",
    "PHANTOM_CLAIM_SUSPECT",
    "ADJUSTER_KICKBACK_RATIO",
    "TOTAL_FINANCIAL_DAMAGE_USD",
    "COUNTRY_CODE",
)


def derive(raw: DataFrame, keep: Sequence[str] = (ROW_POS,)) -> DataFrame:
    """Parsed, decoded and converted claims with their risk measures, before any row is dropped."""
    named = standardize_names(raw, keep=[k for k in keep if k in raw.columns])
    dated = named.transform(parse_dates).transform(impute_dates).transform(add_date_parts)
    read = dated.transform(extract_metadata).transform(decode_contractors)
    return add_risk_features(read)


def _filled(unique: DataFrame) -> DataFrame:
    return unique.transform(impute_medians).transform(fill_text).transform(strip_text)


def finish(derived: DataFrame, order: Sequence[str]) -> DataFrame:
    """First claim of each property and date in ``order``, with gaps filled and text trimmed.

    The deduplicated rows are stored before imputation, because the medians and the final rows both read
    them. Each derived measure is imputed on its own and not computed again.
    """
    return _filled(stored_by_column(keep_first(derived, order).select(*COLUMNS)))


def clean(raw: DataFrame, order: Sequence[str] = (ROW_POS,)) -> DataFrame:
    """The cleaned table. ``order`` names the columns that give the file order of the raw rows.

    Only what the text tells moves and is stored with the first claims; names, date parts and measures follow from it
    and are added afterwards, unless ``order`` asks for one of them.
    """
    order = [o if o in raw.columns else standard_name(o) for o in order]
    keep = [ROW_POS, *[o for o in order if o not in COLUMNS]]
    named = standardize_names(raw, keep=[k for k in keep if k in raw.columns])
    read = named.transform(parse_dates).transform(impute_dates).transform(extract_metadata)
    if not set(order) <= set(read.columns):
        return finish(derive(raw, keep), order)
    first = stored_by_column(keep_first(read, order).select(*[c for c in COLUMNS if c in read.columns]))
    measured = first.transform(decode_contractors).transform(add_date_parts).transform(add_risk_features)
    return _filled(measured.select(*COLUMNS))
