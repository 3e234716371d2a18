"""The expected result of each registered query as SQL over the same tables.

The SQL never parses the damaged form: it states the clean values directly from the order tables.
"""

from __future__ import annotations

from base64 import a85encode

from claimlens.plans.catalog import ARRIVAL, CLAIM_ORDER, COHORTS, FILE_OF_MANAGER, FOREST_KEY, LINE_ORDER, PROFILED
from claimlens.sources.tables import CONTRACTORS, COUNTRIES, CURRENCIES, PROPERTY_TYPES


def _case(subject: str, pairs) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN {k} THEN {v}" for k, v in pairs) + " END"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


RISK = """
    CAST(CAST(VALUATION_LOCAL AS DECIMAL(24,2)) * EXCHANGE_RATE_USD AS DECIMAL(18,6)) AS VALUATION_USD,
    CAST(CAST(CURRENT_PREMIUM_LOCAL AS DECIMAL(24,2)) * EXCHANGE_RATE_USD AS DECIMAL(18,6)) AS CURRENT_PREMIUM_USD,
    CAST(CAST(CAST(CURRENT_PREMIUM_LOCAL AS DECIMAL(24,2)) * EXCHANGE_RATE_USD AS DECIMAL(18,6)) - BASE_PREMIUM_USD AS DECIMAL(18,6))
        AS PREMIUM_SPIKE_USD"""

MEASURES = """
    CASE WHEN VALUATION_USD = 0 THEN 0.0
         ELSE CAST(PAYOUT_AUTHORIZED AS DOUBLE) / CAST(VALUATION_USD AS DOUBLE) END AS PAYOUT_TO_VALUE_RATIO,
    CASE WHEN PREMIUM_SPIKE_USD > 2 * BASE_PREMIUM_USD AND PAYOUT_AUTHORIZED > 50000 THEN 1 ELSE 0 END
        AS PHANTOM_CLAIM_SUSPECT,
    CASE WHEN PAYOUT_AUTHORIZED = 0 THEN 0.0
         ELSE CAST(ADJUSTER_GRATUITY AS DOUBLE) / CAST(PAYOUT_AUTHORIZED AS DOUBLE) END AS ADJUSTER_KICKBACK_RATIO,
    CAST(PAYOUT_AUTHORIZED + PREMIUM_SPIKE_USD AS DECIMAL(18,6)) AS TOTAL_FINANCIAL_DAMAGE_USD"""

RATES = (("'USD'", "1.0000000000"), ("'EUR'", "1.1111111111"), ("'GBP'", "1.3333333333"), ("'CAD'", "0.7407407407"))
RATE = f"CAST({_case('CURRENCY_CODE', RATES)} AS DECIMAL(12,10)) AS EXCHANGE_RATE_USD"

CTES = {
    "typed": f"""
SELECT printf('PRP-%07d', l_partkey) AS PROPERTY_ID,
    l_shipdate AS INCIDENT_DATE,
    'MGR-' || CAST(100 + o_custkey % 200 AS VARCHAR) AS MANAGER_ID,
    'ADJ-' || CAST(1000 + l_suppkey AS VARCHAR) AS ADJUSTER_ID,
    {_case("p_size % 4", enumerate(map(_text, PROPERTY_TYPES)))} AS PROPERTY_TYPE,
    {_case("n_regionkey", enumerate(map(_text, CURRENCIES)))} AS CURRENCY_CODE,
    p_size * 100 AS SQUARE_FOOTAGE,
    CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(p_size AS DECIMAL(4,0)) * 300 AS DECIMAL(18,2)) AS VALUATION_LOCAL,
    CAST((1000 + 10 * CAST(l_quantity AS DECIMAL(6,0))) * (1 + 40 * CAST(abs(l_discount) AS DECIMAL(4,2)))
        AS DECIMAL(18,2)) AS CURRENT_PREMIUM_LOCAL,
    CAST(1000 + 10 * CAST(l_quantity AS DECIMAL(6,0)) AS DECIMAL(18,2)) AS BASE_PREMIUM_USD,
    {_case("n_regionkey", enumerate(map(_text, COUNTRIES)))} AS COUNTRY_CODE,
    CASE WHEN l_linestatus = 'F' THEN 'Structural Fire' ELSE 'Water Damage' END AS INCIDENT_CLASSIFICATION,
    CAST(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END AS DECIMAL(18,2))
        AS PAYOUT_AUTHORIZED,
    CAST(CASE WHEN l_returnflag = 'R'
        THEN CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(abs(l_tax) AS DECIMAL(4,2)) ELSE 0 END AS DECIMAL(18,2))
        AS ADJUSTER_GRATUITY,
    {_case("split_part(p_type, ' ', 1)", ((_text(k), _text(v)) for k, v in CONTRACTORS.items()))} AS DECODED_CONTRACTOR,
    l_orderkey, l_linenumber
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey""",
    "rated": f"""
SELECT * REPLACE (coalesce(DECODED_CONTRACTOR, 'Unknown') AS DECODED_CONTRACTOR), {RATE},
    year(INCIDENT_DATE) AS "YEAR", month(INCIDENT_DATE) AS "MONTH", quarter(INCIDENT_DATE) AS QUARTER
FROM typed""",
    "converted": f"SELECT *, {RISK} FROM rated",
    "claims": f"SELECT *, {MEASURES} FROM converted",
    "suspects": "SELECT * FROM claims WHERE PHANTOM_CLAIM_SUSPECT = 1",
    "portfolio": f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY PROPERTY_ID, INCIDENT_DATE
    ORDER BY {", ".join(CLAIM_ORDER)}) AS rn FROM claims) WHERE rn = 1""",
    "portfolio_suspects": "SELECT * FROM portfolio WHERE PHANTOM_CLAIM_SUSPECT = 1",
    # The damaged form as it reads after parsing, text still padded.
    "raw": f"""
SELECT pad || PROPERTY_ID || tail AS PROPERTY_ID,
    CASE WHEN l_orderkey % 997 = 0 OR l_orderkey % 991 = 1 THEN NULL ELSE INCIDENT_DATE END AS INCIDENT_DATE,
    pad || MANAGER_ID || tail AS MANAGER_ID, pad || ADJUSTER_ID || tail AS ADJUSTER_ID,
    pad || PROPERTY_TYPE || tail AS PROPERTY_TYPE,
    CASE WHEN l_orderkey % 983 = 2 THEN 'XXX' ELSE CURRENCY_CODE END AS CURRENCY_CODE,
    SQUARE_FOOTAGE, VALUATION_LOCAL, CURRENT_PREMIUM_LOCAL, BASE_PREMIUM_USD,
    pad || COUNTRY_CODE || tail AS COUNTRY_CODE,
    CASE WHEN told THEN INCIDENT_CLASSIFICATION END AS INCIDENT_CLASSIFICATION,
    CASE WHEN told THEN PAYOUT_AUTHORIZED END AS PAYOUT_AUTHORIZED,
    CASE WHEN told THEN ADJUSTER_GRATUITY END AS ADJUSTER_GRATUITY,
    CASE WHEN told THEN DECODED_CONTRACTOR END AS DECODED_CONTRACTOR,
    CASE WHEN told THEN token END AS CONTRACTOR_A85,
    CASE WHEN told THEN '{{"incident_classification": "' || INCIDENT_CLASSIFICATION || '", "payout_authorized": '
        || CAST(PAYOUT_AUTHORIZED AS VARCHAR)
        || CASE WHEN l_linenumber % 3 = 0 THEN ', "payout_routing" {{' ELSE ', "payout_routing": {{' END
        || coalesce('"contractor_a85": "' || token || '", ', '')
        || '"adjuster_gratuity": ' || CAST(ADJUSTER_GRATUITY AS VARCHAR) || '}}}}' END AS INSURANCE_METADATA_JSON
FROM (SELECT *, l_orderkey % 499 <> 3 AS told,
        CASE WHEN l_linenumber % 5 = 0 THEN ' ' || chr(9) ELSE '' END AS pad,
        CASE WHEN l_linenumber % 5 = 0 THEN '  ' ELSE '' END AS tail,
        {_case("DECODED_CONTRACTOR", ((_text(c), _text(a85encode(c.encode()).decode())) for c in CONTRACTORS.values()))}
            AS token
    FROM typed)""",
    "dated": """
SELECT * REPLACE (coalesce(INCIDENT_DATE, (SELECT make_timestamp(CAST(floor(median(epoch_us(INCIDENT_DATE))) AS BIGINT))
    FROM raw)) AS INCIDENT_DATE) FROM raw""",
    "derived_rates": f"""
SELECT *, {RATE}, year(INCIDENT_DATE) AS "YEAR", month(INCIDENT_DATE) AS "MONTH", quarter(INCIDENT_DATE) AS QUARTER
FROM dated""",
    "derived_usd": f"SELECT *, {RISK} FROM derived_rates",
    "derived": f"SELECT *, {MEASURES} FROM derived_usd",
}
NEEDS = {
    "rated": ["typed"],
    "converted": ["rated"],
    "claims": ["converted"],
    "suspects": ["claims"],
    "portfolio": ["claims"],
    "portfolio_suspects": ["portfolio"],
    "raw": ["typed"],
    "dated": ["raw"],
    "derived_rates": ["dated"],
    "derived_usd": ["derived_rates"],
    "derived": ["derived_usd"],
}


def _with(names: list[str], body: str, **own: str) -> str:
    """The body behind the shared tables it names and the ones they need; ``own`` come last."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    tables = [f"{n} AS ({CTES[n]})" for n in ordered] + [f"{n} AS ({q})" for n, q in own.items()]
    return "WITH " + ",\n".join(tables) + "\n" + body


def _columns(spec: str) -> str:
    """Columns in plain types: $ amount, # count, @ time; the rest as they are."""
    out = []
    for item in spec.split():
        kind, name = (item[0], item[1:]) if item[0] in "$#@" else ("", item)
        quoted = f'"{name}"'
        form = {
            "$": f"CAST({quoted} AS DOUBLE)",
            "#": f"CAST({quoted} AS BIGINT)",
            "@": f"strftime({quoted}, '%Y-%m-%d %H:%M:%S')",
            "": quoted,
        }[kind]
        out.append(f"{form} AS {quoted}")
    return ", ".join(out)


def _from(table: str, spec: str, rest: str = "", needs: str = "", **own: str) -> str:
    """Columns of a shared table, or of a table in ``own`` built from the shared table ``needs``."""
    return _with([needs or table], f"SELECT {_columns(spec)} FROM {table} {rest}", **own)


def _mean(column: str) -> str:
    return f"CAST(sum({column}) AS DOUBLE) / count({column})"


def _top(source: str, key: str, value: str, out: str, top: int, spec: str) -> str:
    body = f"""SELECT {_columns(spec)} FROM (SELECT {key}, coalesce(sum({value}), 0) AS {out} FROM {source}
        WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY {out} DESC, {key} LIMIT {top})"""
    return _with([source], body)


SHELLS = "DECODED_CONTRACTOR IS NOT NULL AND DECODED_CONTRACTOR <> 'Standard_Vendor'"
LABELS = ", ".join(map(_text, COHORTS))
# Two-sided tail of the t distribution by Simpson's rule over its density.
T_TAIL = """
(SELECT 1 - 2 * sum(CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(lgamma(({v} + 1) / 2.0) - lgamma(({v}) / 2.0) - 0.5 * ln(({v}) * pi())
        - ({v} + 1) / 2.0 * ln(1 + pow(i * ({t}) / 20000, 2) / ({v})))) * abs({t}) / 60000 FROM range(20001) AS g(i))"""


def _correlated(r: str, p: str, digits: int, source: str) -> str:
    """Correlation ``r`` over ``n`` pairs with its p-value, by numeric integration of the t density."""
    tail = T_TAIL.format(t="t", v="n - 2")
    return f"""SELECT round(r, {digits}) AS {r}, CAST(n AS BIGINT) AS observations,
        round(greatest(0, {tail}), 7) + 0.0 AS {p}
    FROM (SELECT r, n, r * sqrt((n - 2) / (1 - r * r)) AS t FROM ({source}))"""


def _profile() -> str:
    parts = []
    for c in PROFILED:
        number = c in ("SQUARE_FOOTAGE", "VALUATION_LOCAL", "PAYOUT_AUTHORIZED")
        num = f"CAST({c} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
        spread = f"stddev_samp({num})" if number else "CAST(NULL AS DOUBLE)"
        quart = [f"quantile_cont({num}, {q})" if number else "CAST(NULL AS DOUBLE)" for q in (0.25, 0.5, 0.75)]
        parts.append(
            f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
    count(DISTINCT {c}) AS distinct_count, min(CAST({c} AS VARCHAR)) AS min_text, max(CAST({c} AS VARCHAR)) AS max_text,
    min({num}) AS min_number, max({num}) AS max_number, round(avg({num}), 4) AS mean,
    (SELECT string_agg(v || ' (' || CAST(n AS VARCHAR) || ')', '; ' ORDER BY n DESC, v) FROM
        (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM typed WHERE {c} IS NOT NULL GROUP BY 1
         ORDER BY n DESC, v LIMIT 3)) AS top_values,
    round({spread}, 4) AS stddev, {quart[0]} AS q1, {quart[1]} AS median, {quart[2]} AS q3 FROM typed"""
        )
    return _with(["typed"], "\nUNION ALL\n".join(parts))


COUNTED = [
    "PROPERTY_ID", "INCIDENT_DATE", "MANAGER_ID", "ADJUSTER_ID", "PROPERTY_TYPE", "CURRENCY_CODE", "SQUARE_FOOTAGE",
    "VALUATION_LOCAL", "CURRENT_PREMIUM_LOCAL", "BASE_PREMIUM_USD", "INSURANCE_METADATA_JSON", "YEAR", "MONTH",
    "QUARTER", "INCIDENT_CLASSIFICATION", "PAYOUT_AUTHORIZED", "CONTRACTOR_A85", "ADJUSTER_GRATUITY",
    "DECODED_CONTRACTOR", "EXCHANGE_RATE_USD", "VALUATION_USD", "CURRENT_PREMIUM_USD", "PREMIUM_SPIKE_USD",
    "PAYOUT_TO_VALUE_RATIO", "PHANTOM_CLAIM_SUSPECT", "ADJUSTER_KICKBACK_RATIO", "TOTAL_FINANCIAL_DAMAGE_USD",
    "COUNTRY_CODE",
]
MISSING = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, CAST(count(*) - count("{c}") AS BIGINT) AS null_count FROM derived""" for c in COUNTED
)

# Numbers the damaged form leaves out, with the type their median is cast to.
IMPUTED = {
    "PAYOUT_AUTHORIZED": "DECIMAL(18,2)",
    "ADJUSTER_GRATUITY": "DECIMAL(18,2)",
    "EXCHANGE_RATE_USD": "DECIMAL(12,10)",
    "VALUATION_USD": "DECIMAL(18,6)",
    "CURRENT_PREMIUM_USD": "DECIMAL(18,6)",
    "PREMIUM_SPIKE_USD": "DECIMAL(18,6)",
    "PAYOUT_TO_VALUE_RATIO": "DOUBLE",
    "ADJUSTER_KICKBACK_RATIO": "DOUBLE",
    "TOTAL_FINANCIAL_DAMAGE_USD": "DECIMAL(18,6)",
}
PADDED = ["PROPERTY_ID", "MANAGER_ID", "ADJUSTER_ID", "PROPERTY_TYPE", "COUNTRY_CODE"]
WHITE = "' ' || chr(9)"
ABSENT = ["INSURANCE_METADATA_JSON", "INCIDENT_CLASSIFICATION", "CONTRACTOR_A85", "DECODED_CONTRACTOR"]

CLEAN_SPEC = """PROPERTY_ID @INCIDENT_DATE MANAGER_ID ADJUSTER_ID PROPERTY_TYPE CURRENCY_CODE #SQUARE_FOOTAGE
$VALUATION_LOCAL $CURRENT_PREMIUM_LOCAL $BASE_PREMIUM_USD INSURANCE_METADATA_JSON #YEAR #MONTH #QUARTER
INCIDENT_CLASSIFICATION $PAYOUT_AUTHORIZED CONTRACTOR_A85 $ADJUSTER_GRATUITY DECODED_CONTRACTOR $EXCHANGE_RATE_USD
$VALUATION_USD $CURRENT_PREMIUM_USD $PREMIUM_SPIKE_USD $PAYOUT_TO_VALUE_RATIO #PHANTOM_CLAIM_SUSPECT
$ADJUSTER_KICKBACK_RATIO $TOTAL_FINANCIAL_DAMAGE_USD COUNTRY_CODE"""
CLEAN = _with(
    ["derived"],
    f"SELECT {_columns(CLEAN_SPEC)} FROM filled",
    first=f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY PROPERTY_ID, INCIDENT_DATE ORDER BY
        {", ".join(f"{c} NULLS LAST" for c in [*CLAIM_ORDER, "CURRENCY_CODE", "CONTRACTOR_A85"])}) AS rn FROM derived)
        WHERE rn = 1""",
    filled="SELECT * REPLACE ("
    + ", ".join(
        [f"coalesce({c}, CAST((SELECT median(CAST({c} AS DOUBLE)) FROM first) AS {t})) AS {c}" for c, t in IMPUTED.items()]
        + [f"trim({c}, {WHITE}) AS {c}" for c in PADDED]
        + [f"coalesce({c}, 'Unknown') AS {c}" for c in ABSENT]
    )
    + ") FROM first",
)

MART_TYPED = """PROPERTY_ID @INCIDENT_DATE MANAGER_ID ADJUSTER_ID PROPERTY_TYPE CURRENCY_CODE #SQUARE_FOOTAGE
$VALUATION_LOCAL $CURRENT_PREMIUM_LOCAL $BASE_PREMIUM_USD COUNTRY_CODE INCIDENT_CLASSIFICATION $PAYOUT_AUTHORIZED
$ADJUSTER_GRATUITY DECODED_CONTRACTOR #YEAR #MONTH #QUARTER $EXCHANGE_RATE_USD $VALUATION_USD $CURRENT_PREMIUM_USD
$PREMIUM_SPIKE_USD $PAYOUT_TO_VALUE_RATIO #PHANTOM_CLAIM_SUSPECT $ADJUSTER_KICKBACK_RATIO $TOTAL_FINANCIAL_DAMAGE_USD"""
MART_ADDED = """valuation_tier #payout_decile $running_total_damage_usd $fake_payout_total #adjuster_rank
#first_corrupt_claim $total_bribes #unique_shell_companies $adjuster_total_authorized_payouts
#contractor_total_incidents $contractor_total_payout_stolen $contractor_avg_premium_spike"""
TIER = "CASE WHEN VALUATION_USD > 10000000 THEN 'Tier 1' WHEN VALUATION_USD >= 1000000 THEN 'Tier 2' ELSE 'Tier 3' END"


def _trackers(source: str) -> dict[str, str]:
    return {
        "adjusters": f"""SELECT ADJUSTER_ID AS adjuster_id, sum(ADJUSTER_GRATUITY) AS total_bribes,
    count(DISTINCT CASE WHEN DECODED_CONTRACTOR <> 'Standard_Vendor' THEN DECODED_CONTRACTOR END)
        AS unique_shell_companies,
    sum(PAYOUT_AUTHORIZED) AS total_authorized_payouts FROM {source} GROUP BY ADJUSTER_ID""",
        "contractors": f"""SELECT DECODED_CONTRACTOR AS contractor, count(*) AS total_incidents,
    sum(PAYOUT_AUTHORIZED) AS total_payout_stolen, {_mean("PREMIUM_SPIKE_USD")} AS avg_premium_spike
    FROM {source} WHERE {SHELLS} GROUP BY DECODED_CONTRACTOR""",
    }


RANKS = """SELECT COUNTRY_CODE, ADJUSTER_ID, sum(PAYOUT_AUTHORIZED) AS fake_payout_total,
    rank() OVER (PARTITION BY COUNTRY_CODE ORDER BY sum(PAYOUT_AUTHORIZED) DESC) AS adjuster_rank
    FROM {source} GROUP BY COUNTRY_CODE, ADJUSTER_ID"""
MART = dict(
    ranks=RANKS.format(source="portfolio_suspects"),
    firsts="""SELECT DISTINCT PROPERTY_ID, INCIDENT_DATE, 1 AS mark FROM (SELECT *, row_number() OVER
    (PARTITION BY MANAGER_ID ORDER BY INCIDENT_DATE, PROPERTY_ID) AS n FROM portfolio_suspects) WHERE n = 1""",
    **_trackers("portfolio"),
    mart=f"""SELECT b.*, {TIER} AS valuation_tier,
    ntile(10) OVER (ORDER BY PAYOUT_AUTHORIZED, b.PROPERTY_ID, b.INCIDENT_DATE) AS payout_decile,
    sum(TOTAL_FINANCIAL_DAMAGE_USD) OVER (PARTITION BY b.COUNTRY_CODE ORDER BY b.INCIDENT_DATE, b.PROPERTY_ID
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_total_damage_usd,
    r.fake_payout_total, r.adjuster_rank, coalesce(f.mark, 0) AS first_corrupt_claim,
    a.total_bribes, a.unique_shell_companies, a.total_authorized_payouts AS adjuster_total_authorized_payouts,
    c.total_incidents AS contractor_total_incidents, c.total_payout_stolen AS contractor_total_payout_stolen,
    c.avg_premium_spike AS contractor_avg_premium_spike
    FROM portfolio b
    LEFT JOIN ranks r ON b.COUNTRY_CODE = r.COUNTRY_CODE AND b.ADJUSTER_ID = r.ADJUSTER_ID
    LEFT JOIN firsts f ON b.PROPERTY_ID = f.PROPERTY_ID AND b.INCIDENT_DATE = f.INCIDENT_DATE
    LEFT JOIN adjusters a ON b.ADJUSTER_ID = a.adjuster_id
    LEFT JOIN contractors c ON b.DECODED_CONTRACTOR = c.contractor""",
)

NODE = "PROPERTY_ID || '@' || strftime(INCIDENT_DATE, '%Y-%m-%d %H:%M:%S')"
PATHS = (
    "WITH RECURSIVE "
    + _with(
        ["portfolio_suspects"],
        """SELECT incident, CAST(payout AS DOUBLE) AS payout, root, CAST(depth AS BIGINT) AS depth, node, node_type, path
    FROM walk""",
        edges=f"""SELECT {NODE} AS incident, PAYOUT_AUTHORIZED AS payout, 'manager' AS from_type, MANAGER_ID AS from_node,
        'incident' AS to_type, {NODE} AS to_node FROM portfolio_suspects
    UNION ALL SELECT {NODE}, PAYOUT_AUTHORIZED, 'incident', {NODE}, 'adjuster', ADJUSTER_ID FROM portfolio_suspects
    UNION ALL SELECT {NODE}, PAYOUT_AUTHORIZED, 'adjuster', ADJUSTER_ID, 'contractor', DECODED_CONTRACTOR
        FROM portfolio_suspects""",
        walk="""SELECT incident, payout, from_node AS root, 0 AS depth, from_node AS node, 'manager' AS node_type,
        from_node AS path FROM edges WHERE from_type = 'manager'
    UNION ALL SELECT w.incident, w.payout, w.root, w.depth + 1, e.to_node, e.to_type, w.path || ' -> ' || e.to_node
        FROM walk w JOIN edges e ON w.incident = e.incident AND w.node = e.from_node AND w.node_type = e.from_type
        WHERE w.depth < 3""",
    ).removeprefix("WITH ")
)

DAILY = f"SELECT INCIDENT_DATE, {_mean('PREMIUM_SPIKE_USD')} AS mean_spike FROM claims GROUP BY INCIDENT_DATE"
DAMAGE = """SELECT MANAGER_ID, total_damage_usd, sum(total_damage_usd) OVER o AS cumulative_damage,
    CAST(sum(total_damage_usd) OVER o AS DOUBLE) / CAST(sum(total_damage_usd) OVER () AS DOUBLE) AS share,
    row_number() OVER o AS place, count(*) OVER () AS managers
    FROM (SELECT MANAGER_ID, sum(TOTAL_FINANCIAL_DAMAGE_USD) AS total_damage_usd FROM claims GROUP BY MANAGER_ID)
    WINDOW o AS (ORDER BY total_damage_usd DESC, MANAGER_ID ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
DIGITS = """SELECT n AS observations, d AS digit, observed, observed / n AS observed_share,
    log10(1 + 1.0 / d) AS expected_share, abs(observed / n - log10(1 + 1.0 / d)) AS abs_deviation
    FROM (SELECT d, (SELECT count(*) FROM digits WHERE digit = d) AS observed, (SELECT count(digit) FROM digits) AS n
        FROM range(1, 10) AS g(d))"""
LEADING = """SELECT CAST(regexp_extract(CAST(PAYOUT_AUTHORIZED AS VARCHAR), '([1-9])', 1) AS INTEGER) AS digit
    FROM claims WHERE PAYOUT_AUTHORIZED > 0"""
X, Y = "CAST(VALUATION_USD AS DOUBLE)", "CAST(PAYOUT_AUTHORIZED AS DOUBLE)"


def _listed(spec: str) -> str:
    return _from("claims", spec)


ORACLES: dict[str, str] = {
    "raw_csv_claims": _from(
        "raw",
        """PROPERTY_ID @INCIDENT_DATE MANAGER_ID ADJUSTER_ID PROPERTY_TYPE CURRENCY_CODE $SQUARE_FOOTAGE $VALUATION_LOCAL
    $CURRENT_PREMIUM_LOCAL $BASE_PREMIUM_USD INSURANCE_METADATA_JSON COUNTRY_CODE INCIDENT_CLASSIFICATION
    $PAYOUT_AUTHORIZED CONTRACTOR_A85 $ADJUSTER_GRATUITY""",
    ),
    "first_in_file_order": _with(
        ["typed"],
        f"""SELECT PROPERTY_ID, strftime(INCIDENT_DATE, '%Y-%m-%d %H:%M:%S') AS INCIDENT_DATE,
    CAST(PAYOUT_AUTHORIZED AS DOUBLE) AS PAYOUT_AUTHORIZED, CAST(ADJUSTER_GRATUITY AS DOUBLE) AS ADJUSTER_GRATUITY,
    ADJUSTER_ID, MANAGER_ID, CAST(VALUATION_LOCAL AS DOUBLE) AS VALUATION_LOCAL,
    CAST(BASE_PREMIUM_USD AS DOUBLE) AS BASE_PREMIUM_USD, CAST(CURRENT_PREMIUM_LOCAL AS DOUBLE) AS CURRENT_PREMIUM_LOCAL
    FROM (SELECT *, row_number() OVER (PARTITION BY PROPERTY_ID, INCIDENT_DATE ORDER BY {FILE_OF_MANAGER},
        {", ".join(LINE_ORDER)}) AS line FROM typed) WHERE line = 1""",
    ),
    "mart_csv_coercion": _with(
        ["claims"],
        """SELECT PROPERTY_ID,
    CASE WHEN PHANTOM_CLAIM_SUSPECT = 0 THEN strftime(INCIDENT_DATE, '%Y-%m-%d %H:%M:%S') END AS INCIDENT_DATE,
    CASE WHEN PAYOUT_AUTHORIZED <> 0 THEN CAST(PAYOUT_AUTHORIZED AS DOUBLE) END AS PAYOUT_AUTHORIZED,
    CAST(VALUATION_USD AS DOUBLE) AS VALUATION_USD FROM claims""",
    ),
    "partitioned_claims": _listed("PROPERTY_ID $PAYOUT_AUTHORIZED @INCIDENT_DATE COUNTRY_CODE"),
    "partition_property_ids": _with(
        ["claims"],
        """SELECT COUNTRY_CODE, count(*) AS claims, count(DISTINCT PROPERTY_ID) AS properties
    FROM claims GROUP BY COUNTRY_CODE""",
    ),
    "country_backfill": _with(
        ["claims"],
        """SELECT c.PROPERTY_ID, strftime(INCIDENT_DATE, '%Y-%m-%d %H:%M:%S') AS INCIDENT_DATE, MANAGER_ID,
    coalesce(found, CASE WHEN MANAGER_ID >= 'MGR-200' THEN COUNTRY_CODE END) AS COUNTRY_CODE FROM claims c LEFT JOIN
    (SELECT PROPERTY_ID, max(COUNTRY_CODE) AS found FROM claims WHERE MANAGER_ID < 'MGR-200' GROUP BY PROPERTY_ID) l
    ON c.PROPERTY_ID = l.PROPERTY_ID""",
    ),
    "nan_to_null": _with(
        ["claims"],
        """SELECT PROPERTY_ID, strftime(INCIDENT_DATE, '%Y-%m-%d %H:%M:%S') AS INCIDENT_DATE,
    CASE WHEN PAYOUT_AUTHORIZED <> 0 THEN ADJUSTER_KICKBACK_RATIO END AS ADJUSTER_KICKBACK_RATIO FROM claims""",
    ),
    "quoted_rank_file": _from(
        "r",
        "COUNTRY_CODE ADJUSTER_ID $fake_payout_total #adjuster_rank",
        needs="suspects",
        r=RANKS.format(source="suspects"),
    ),
    "manager_payout_json": _with(
        ["claims"],
        "SELECT MANAGER_ID, CAST(sum(PAYOUT_AUTHORIZED) AS DOUBLE) AS total_payout FROM claims GROUP BY MANAGER_ID",
    ),
    "clustered_layout": _listed("ADJUSTER_ID @INCIDENT_DATE PROPERTY_ID $PAYOUT_AUTHORIZED"),
    "mixed_dates": _from("raw", "PROPERTY_ID MANAGER_ID @INCIDENT_DATE"),
    "imputed_dates": _from("derived_rates", "PROPERTY_ID MANAGER_ID @INCIDENT_DATE #YEAR #MONTH #QUARTER"),
    "missing_dates": _with(
        ["raw"],
        """SELECT count(*) - count(INCIDENT_DATE) AS missing_before, count(*) FILTER (WHERE l_orderkey % 997 = 0) AS blank_before,
    count(*) FILTER (WHERE l_orderkey % 997 <> 0 AND l_orderkey % 991 = 1) AS unreadable_before,
    CAST(0 AS BIGINT) AS missing_after FROM typed_raw""",
        typed_raw="""SELECT l_orderkey, CASE WHEN l_orderkey % 997 = 0 OR l_orderkey % 991 = 1 THEN NULL ELSE INCIDENT_DATE END
    AS INCIDENT_DATE FROM typed""",
    ),
    "metadata_fields": _from(
        "raw", "PROPERTY_ID INCIDENT_CLASSIFICATION $PAYOUT_AUTHORIZED CONTRACTOR_A85 $ADJUSTER_GRATUITY"
    ),
    "decoded_contractors": _from("raw", "PROPERTY_ID MANAGER_ID DECODED_CONTRACTOR"),
    "contractor_frequency": _with(
        ["raw"],
        """SELECT DECODED_CONTRACTOR, count(*) AS claims FROM raw WHERE DECODED_CONTRACTOR IS NOT NULL
    GROUP BY DECODED_CONTRACTOR ORDER BY claims DESC, DECODED_CONTRACTOR LIMIT 5""",
    ),
    "classified_claims": _from(
        "raw", "PROPERTY_ID MANAGER_ID INCIDENT_CLASSIFICATION", "WHERE INCIDENT_CLASSIFICATION IS NOT NULL"
    ),
    "unknown_currencies": _with(
        ["raw"], "SELECT count(*) AS unknown_currency_rows FROM raw WHERE CURRENCY_CODE = 'XXX'"
    ),
    "risk_features": _from(
        "derived",
        """PROPERTY_ID $EXCHANGE_RATE_USD $VALUATION_USD $CURRENT_PREMIUM_USD $PREMIUM_SPIKE_USD PAYOUT_TO_VALUE_RATIO
    #PHANTOM_CLAIM_SUSPECT ADJUSTER_KICKBACK_RATIO $TOTAL_FINANCIAL_DAMAGE_USD""",
    ),
    "clean_portfolio": CLEAN,
    "median_imputation": _with(
        ["claims"],
        """SELECT PROPERTY_ID, CAST(coalesce(p, CAST((SELECT median(CAST(p AS DOUBLE)) FROM gaps) AS DECIMAL(18,2)))
        AS DOUBLE) AS PAYOUT_AUTHORIZED,
    CAST(coalesce(v, CAST((SELECT median(CAST(v AS DOUBLE)) FROM gaps) AS DECIMAL(18,6))) AS DOUBLE) AS VALUATION_USD,
    coalesce(s, (SELECT median(s) FROM gaps)) AS SQUARE_FOOTAGE FROM gaps""",
        gaps="""SELECT PROPERTY_ID, CASE WHEN QUARTER <> 1 THEN PAYOUT_AUTHORIZED END AS p,
        CASE WHEN QUARTER <> 2 THEN VALUATION_USD END AS v,
        CASE WHEN QUARTER <> 3 THEN CAST(SQUARE_FOOTAGE AS DOUBLE) END AS s FROM claims""",
    ),
    "text_cleanup": _with(
        ["raw"],
        f"""SELECT trim(PROPERTY_ID, {WHITE}) AS PROPERTY_ID, trim(MANAGER_ID, {WHITE}) AS MANAGER_ID,
    CASE WHEN COUNTRY_CODE = 'US' THEN 'Unknown' ELSE trim(PROPERTY_TYPE, {WHITE}) END AS PROPERTY_TYPE,
    CASE WHEN COUNTRY_CODE = 'UK' THEN '' ELSE trim(COUNTRY_CODE, {WHITE}) END AS COUNTRY_CODE FROM raw""",
    ),
    "valuation_tiers": _with(
        ["claims"],
        f"SELECT PROPERTY_ID, CAST(VALUATION_USD AS DOUBLE) AS VALUATION_USD, {TIER} AS valuation_tier FROM claims",
    ),
    "cohort_payouts": _from("claims", "DECODED_CONTRACTOR $PAYOUT_AUTHORIZED", f"WHERE DECODED_CONTRACTOR IN ({LABELS})"),
    "finite_features": _with(
        ["claims"],
        """SELECT PROPERTY_ID, CASE WHEN COUNTRY_CODE IN ('CA', 'FR')
    THEN (SELECT median(PAYOUT_TO_VALUE_RATIO) FROM claims WHERE COUNTRY_CODE NOT IN ('CA', 'FR'))
    ELSE PAYOUT_TO_VALUE_RATIO END AS PAYOUT_TO_VALUE_RATIO FROM claims""",
    ),
    "duplicate_count": _with(
        ["typed"],
        """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT PROPERTY_ID, INCIDENT_DATE FROM typed))
    AS duplicate_rows FROM typed""",
    ),
    "deduplicated_claims": _from(
        "portfolio",
        """PROPERTY_ID @INCIDENT_DATE MANAGER_ID ADJUSTER_ID $PAYOUT_AUTHORIZED $ADJUSTER_GRATUITY $BASE_PREMIUM_USD
    $CURRENT_PREMIUM_LOCAL COUNTRY_CODE INCIDENT_CLASSIFICATION""",
    ),
    "premium_violations": _with(
        ["claims"],
        "\nUNION ALL\n".join(
            f"""SELECT '{c}' AS rule_column, count(*) FILTER (WHERE {c} IS NULL OR {c} < 0) AS violations FROM claims"""
            for c in ("CURRENT_PREMIUM_LOCAL", "BASE_PREMIUM_USD", "CURRENT_PREMIUM_USD")
        ),
    ),
    "row_count": _with(["claims"], "SELECT count(*) AS row_count FROM claims"),
    "country_completeness": _with(
        ["claims"],
        """SELECT count(*) AS total_rows, count(COUNTRY_CODE) AS filled_rows,
    count(DISTINCT COUNTRY_CODE) AS distinct_values FROM claims""",
    ),
    "null_counts": _with(["derived"], f"SELECT * FROM ({MISSING}) WHERE null_count > 0"),
    "null_total": _with(["derived"], f"SELECT CAST(sum(null_count) AS BIGINT) AS total_nulls FROM ({MISSING})"),
    "column_profile": _profile(),
    "top_adjusters": _top("claims", "ADJUSTER_ID", "ADJUSTER_GRATUITY", "total_gratuity", 5, "ADJUSTER_ID $total_gratuity"),
    "top_contractors": _top(
        "typed", "DECODED_CONTRACTOR", "PAYOUT_AUTHORIZED", "total_payout", 10, "DECODED_CONTRACTOR $total_payout"
    ),
    "suspect_mean_spike": _with(
        ["suspects"], f"SELECT {_mean('PREMIUM_SPIKE_USD')} AS mean_premium_spike FROM suspects"
    ),
    "total_payout": _with(
        ["claims"], "SELECT CAST(abs(sum(PAYOUT_AUTHORIZED)) AS DOUBLE) AS total_payout FROM claims"
    ),
    "payout_by_manager": _with(
        ["claims"],
        "SELECT MANAGER_ID, CAST(sum(PAYOUT_AUTHORIZED) AS DOUBLE) AS total_payout FROM claims GROUP BY MANAGER_ID",
    ),
    "claims_per_country": _with(
        ["claims"], "SELECT COUNTRY_CODE, count(*) AS claims FROM claims GROUP BY COUNTRY_CODE ORDER BY COUNTRY_CODE"
    ),
    "ratio_by_tier": _with(
        ["claims"],
        f"""SELECT {TIER} AS valuation_tier, count(*) AS property_count,
    round(avg(PAYOUT_TO_VALUE_RATIO), 6) AS avg_payout_to_value_ratio,
    max(PAYOUT_TO_VALUE_RATIO) AS max_payout_to_value_ratio FROM claims GROUP BY 1""",
    ),
    "decile_summary": _with(
        ["claims"],
        f"""SELECT CAST(payout_decile AS BIGINT) AS payout_decile, count(*) AS property_count,
    CAST(min(PAYOUT_AUTHORIZED) AS DOUBLE) AS min_payout, CAST(max(PAYOUT_AUTHORIZED) AS DOUBLE) AS max_payout,
    {_mean("PAYOUT_AUTHORIZED")} AS avg_payout
    FROM (SELECT *, ntile(10) OVER (ORDER BY PAYOUT_AUTHORIZED) AS payout_decile FROM claims) GROUP BY payout_decile""",
    ),
    "contractor_concentration": _with(
        ["claims"],
        f"""SELECT DECODED_CONTRACTOR AS contractor, count(DISTINCT ADJUSTER_ID) AS distinct_adjusters,
    CAST(sum(PAYOUT_AUTHORIZED) AS DOUBLE) AS total_payout FROM claims WHERE {SHELLS} GROUP BY DECODED_CONTRACTOR
    HAVING count(DISTINCT ADJUSTER_ID) > 3""",
    ),
    "adjuster_tracker": _with(
        ["claims"],
        f"SELECT {_columns('adjuster_id $total_bribes #unique_shell_companies $total_authorized_payouts')} FROM adjusters",
        **_trackers("claims"),
    ),
    "contractor_tracker": _with(
        ["claims"],
        f"SELECT {_columns('contractor #total_incidents $total_payout_stolen $avg_premium_spike')} FROM contractors",
        **_trackers("claims"),
    ),
    "refreshed_trackers": _with(
        ["claims"],
        """SELECT adjuster_id AS tracked, CAST(total_authorized_payouts AS DOUBLE) AS payout FROM adjusters
    UNION ALL SELECT contractor, CAST(total_payout_stolen AS DOUBLE) FROM contractors""",
        **_trackers("claims"),
    ),
    "pareto_managers": _with(
        ["claims"],
        """SELECT MANAGER_ID, CAST(total_damage_usd AS DOUBLE) AS total_damage_usd,
    CAST(cumulative_damage AS DOUBLE) AS cumulative_damage, round(share, 10) AS cumulative_share FROM damage
    WHERE place <= greatest(1, ceil(managers * 0.2))""",
        damage=DAMAGE,
    ),
    "cumulative_damage": _with(
        ["claims"],
        """SELECT MANAGER_ID, CAST(total_damage_usd AS DOUBLE) AS total_damage_usd,
    CAST(cumulative_damage AS DOUBLE) AS cumulative_damage, round(share, 10) AS cumulative_share,
    place, managers FROM damage""",
        damage=DAMAGE,
    ),
    "premium_deviation": _with(
        ["claims"],
        f"""SELECT round(avg(abs(CAST(CURRENT_PREMIUM_USD AS DOUBLE) - (SELECT {_mean("CURRENT_PREMIUM_USD")} FROM claims))), 6)
    AS mean_absolute_deviation FROM claims""",
    ),
    "monthly_gratuity": _with(
        ["claims"],
        f"""SELECT strftime(CAST(date_trunc('month', INCIDENT_DATE) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS month,
    {_mean("ADJUSTER_GRATUITY")} AS mean_gratuity FROM claims GROUP BY 1""",
    ),
    "daily_spike": _with(
        ["claims"],
        """SELECT strftime(INCIDENT_DATE, '%Y-%m-%d %H:%M:%S') AS INCIDENT_DATE, mean_spike
    FROM daily""",
        daily=DAILY,
    ),
    "spike_trend": _with(
        ["claims"],
        # A double as two exact decimals, whose sums no order of addition changes; rounded as it is written, half up.
        """SELECT strftime(INCIDENT_DATE, '%Y-%m-%d %H:%M:%S') AS INCIDENT_DATE, mean_spike,
    CAST(CAST(CAST((CAST(sum(a) OVER recent AS DOUBLE) + CAST(sum(b) OVER recent AS DOUBLE) / 1e24) / count(mean_spike) OVER recent
        AS VARCHAR) AS DECIMAL(38,9)) AS DOUBLE) AS rolling_mean_spike
    FROM (SELECT *, CAST(CAST((mean_spike - CAST(a AS DOUBLE)) * 1e24 AS VARCHAR) AS DECIMAL(38,0)) AS b
        FROM (SELECT *, CAST(CAST(mean_spike AS VARCHAR) AS DECIMAL(38,12)) AS a FROM daily))
    WINDOW recent AS (ORDER BY INCIDENT_DATE RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)""",
        daily=DAILY,
    ),
    "payout_by_property_type": _with(
        ["claims"],
        f"""SELECT PROPERTY_TYPE, count(PAYOUT_AUTHORIZED) AS count, {_mean("PAYOUT_AUTHORIZED")} AS mean,
    round(stddev_samp({Y}), 4) AS std, CAST(sum(PAYOUT_AUTHORIZED) AS DOUBLE) AS sum, median({Y}) AS median
    FROM claims GROUP BY PROPERTY_TYPE""",
    ),
    "payout_statistics": _with(
        ["claims"],
        f"""SELECT {_mean("PAYOUT_AUTHORIZED")} AS mean, round(stddev_samp({Y}), 4) AS std, min({Y}) AS min,
    max({Y}) AS max, count(PAYOUT_AUTHORIZED) AS count, median({Y}) AS median FROM claims""",
    ),
    "box_statistics": _with(
        ["claims"],
        f"""SELECT c.DECODED_CONTRACTOR, q1, median, q3,
    min({Y}) FILTER (WHERE {Y} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low_whisker,
    max({Y}) FILTER (WHERE {Y} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high_whisker,
    count(*) FILTER (WHERE {Y} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers,
    count(*) AS claims FROM claims c JOIN
    (SELECT DECODED_CONTRACTOR, quantile_cont({Y}, 0.25) AS q1, median({Y}) AS median, quantile_cont({Y}, 0.75) AS q3
     FROM claims WHERE DECODED_CONTRACTOR IN ({LABELS}) GROUP BY DECODED_CONTRACTOR) q
    ON c.DECODED_CONTRACTOR = q.DECODED_CONTRACTOR GROUP BY ALL""",
    ),
    "rank_adjusters_by_country": _with(
        ["suspects"],
        f"SELECT {_columns('COUNTRY_CODE ADJUSTER_ID $fake_payout_total #adjuster_rank')} FROM r",
        r=RANKS.format(source="suspects"),
    ),
    "repeat_claims": _with(
        ["claims"],
        f"""SELECT {_columns('''PROPERTY_ID @INCIDENT_DATE MANAGER_ID ADJUSTER_ID $PAYOUT_AUTHORIZED next_property_id
        @next_incident_date next_adjuster_id $next_payout_authorized''')} FROM led WHERE ADJUSTER_ID = next_adjuster_id""",
        led="""SELECT *, lead(PROPERTY_ID) OVER w AS next_property_id, lead(INCIDENT_DATE) OVER w AS next_incident_date,
        lead(ADJUSTER_ID) OVER w AS next_adjuster_id, lead(PAYOUT_AUTHORIZED) OVER w AS next_payout_authorized
        FROM claims WINDOW w AS (PARTITION BY MANAGER_ID
            ORDER BY INCIDENT_DATE, PROPERTY_ID, ADJUSTER_ID, PAYOUT_AUTHORIZED)""",
    ),
    "payout_deciles": _with(
        ["claims"],
        f"""SELECT {_columns("$PAYOUT_AUTHORIZED PROPERTY_ID @INCIDENT_DATE MANAGER_ID ADJUSTER_ID #payout_decile")}
    FROM (SELECT *, ntile(10) OVER (ORDER BY PAYOUT_AUTHORIZED, PROPERTY_ID, INCIDENT_DATE, MANAGER_ID, ADJUSTER_ID)
        AS payout_decile FROM claims)""",
    ),
    "running_damage": _with(
        ["claims"],
        f"""SELECT {_columns('''COUNTRY_CODE @INCIDENT_DATE PROPERTY_ID $TOTAL_FINANCIAL_DAMAGE_USD
        $running_total_damage_usd''')}
    FROM (SELECT *, sum(TOTAL_FINANCIAL_DAMAGE_USD) OVER (PARTITION BY COUNTRY_CODE
        ORDER BY INCIDENT_DATE, PROPERTY_ID, TOTAL_FINANCIAL_DAMAGE_USD
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_total_damage_usd FROM claims)""",
    ),
    "first_suspect_claims": _with(
        ["suspects"],
        """SELECT MANAGER_ID, PROPERTY_ID, strftime(INCIDENT_DATE, '%Y-%m-%d %H:%M:%S') AS INCIDENT_DATE,
    CAST(PAYOUT_AUTHORIZED AS DOUBLE) AS payout_authorized FROM (SELECT *, row_number() OVER (PARTITION BY MANAGER_ID
        ORDER BY INCIDENT_DATE, PROPERTY_ID, PAYOUT_AUTHORIZED) AS claim_number FROM suspects) WHERE claim_number = 1""",
    ),
    "reporting_mart": _with(
        ["portfolio_suspects"], f"SELECT {_columns(MART_TYPED)}, {_columns(MART_ADDED)} FROM mart", **MART
    ),
    "mart_preview": _with(
        ["portfolio_suspects"],
        f"""SELECT {_columns("PROPERTY_ID @INCIDENT_DATE #payout_decile #adjuster_rank #first_corrupt_claim")}
    FROM (SELECT * FROM mart ORDER BY PROPERTY_ID, INCIDENT_DATE LIMIT 1000)""",
        **MART,
    ),
    "claim_paths": PATHS,
    "walked_paths": PATHS,
    "relationship_concentration": _with(
        ["suspects"],
        """SELECT MANAGER_ID, ADJUSTER_ID, DECODED_CONTRACTOR, count(*) AS claims,
    CAST(sum(PAYOUT_AUTHORIZED) AS DOUBLE) AS total_payout FROM suspects GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    ),
    "portfolio_figures": _with(
        ["claims"],
        """SELECT count(*) AS row_count, CAST(sum(PAYOUT_AUTHORIZED) AS DOUBLE) AS total_payout_authorized,
    CAST(sum(TOTAL_FINANCIAL_DAMAGE_USD) AS DOUBLE) AS total_financial_damage,
    count(*) FILTER (WHERE PHANTOM_CLAIM_SUSPECT = 1) AS phantom_claim_count,
    CAST(sum(PAYOUT_AUTHORIZED) FILTER (WHERE PHANTOM_CLAIM_SUSPECT = 1) AS DOUBLE) AS suspect_payout,
    CAST(sum(TOTAL_FINANCIAL_DAMAGE_USD) FILTER (WHERE PHANTOM_CLAIM_SUSPECT = 1) AS DOUBLE) AS suspect_damage
    FROM claims""",
    ),
    "top_suspect_adjusters": _top(
        "suspects", "ADJUSTER_ID", "ADJUSTER_GRATUITY", "total_gratuity", 5, "ADJUSTER_ID $total_gratuity"
    ),
    "top_suspect_managers": _top(
        "suspects",
        "MANAGER_ID",
        "TOTAL_FINANCIAL_DAMAGE_USD",
        "total_financial_damage",
        5,
        "MANAGER_ID $total_financial_damage",
    ),
    "top_suspect_contractors": _top(
        "suspects", "DECODED_CONTRACTOR", "PAYOUT_AUTHORIZED", "total_payout", 5, "DECODED_CONTRACTOR $total_payout"
    ),
    "policy_review": _from(
        "review",
        """PROPERTY_ID MANAGER_ID ADJUSTER_ID DECODED_CONTRACTOR $PAYOUT_AUTHORIZED $PREMIUM_SPIKE_USD
    $TOTAL_FINANCIAL_DAMAGE_USD PAYOUT_TO_VALUE_RATIO""",
        needs="suspects",
        review="""SELECT * FROM suspects ORDER BY TOTAL_FINANCIAL_DAMAGE_USD DESC, PROPERTY_ID, MANAGER_ID, ADJUSTER_ID,
    DECODED_CONTRACTOR, PAYOUT_AUTHORIZED, PREMIUM_SPIKE_USD, PAYOUT_TO_VALUE_RATIO LIMIT 5""",
    ),
    "audit_rows": _from(
        "audited",
        """PROPERTY_ID @INCIDENT_DATE MANAGER_ID ADJUSTER_ID $PAYOUT_AUTHORIZED $ADJUSTER_GRATUITY $BASE_PREMIUM_USD
    $CURRENT_PREMIUM_LOCAL COUNTRY_CODE INCIDENT_CLASSIFICATION $TOTAL_FINANCIAL_DAMAGE_USD #PHANTOM_CLAIM_SUSPECT""",
        needs="suspects",
        audited=f"""SELECT * FROM suspects ORDER BY PROPERTY_ID, INCIDENT_DATE, {", ".join(CLAIM_ORDER)},
    TOTAL_FINANCIAL_DAMAGE_USD LIMIT 150000""",
    ),
    "welch_test": _with(
        ["claims"],
        f"""SELECT first_count, second_count, first_mean, second_mean,
    round(t, 8) AS t_statistic, round(v, 4) AS degrees_of_freedom, round(p, 7) AS two_sided_p_value,
    round(CASE WHEN t > 0 THEN p / 2 ELSE 1 - p / 2 END, 7) AS one_sided_p_value,
    CASE WHEN t > 0 THEN p / 2 ELSE 1 - p / 2 END < 0.05 AS significant_at_0_05
    FROM (SELECT *, greatest(0, {T_TAIL.format(t="t", v="v")}) AS p FROM tested)""",
        moments="\nUNION ALL\n".join(
            f"""SELECT {i} AS c, count(PAYOUT_AUTHORIZED) AS n, {_mean("PAYOUT_AUTHORIZED")} AS m, var_samp({Y}) AS s
        FROM claims WHERE DECODED_CONTRACTOR = {_text(label)}"""
            for i, label in enumerate(COHORTS)
        ),
        tested="""SELECT a.n AS first_count, b.n AS second_count, a.m AS first_mean, b.m AS second_mean,
        (a.m - b.m) / sqrt(a.s / a.n + b.s / b.n) AS t, pow(a.s / a.n + b.s / b.n, 2)
            / (pow(a.s / a.n, 2) / (a.n - 1) + pow(b.s / b.n, 2) / (b.n - 1)) AS v
        FROM moments a, moments b WHERE a.c = 0 AND b.c = 1""",
    ),
    "benford_digits": _with(
        ["claims"],
        """SELECT observations, CAST(digit AS BIGINT) AS digit, observed, round(observed_share, 10) AS observed_share,
    round(expected_share, 10) AS expected_share, round(abs_deviation, 10) AS abs_deviation FROM tabled""",
        digits=LEADING,
        tabled=DIGITS,
    ),
    "benford_test": _with(
        ["claims"],
        """SELECT observations, round(mad, 10) AS mean_absolute_deviation, round(x, 5) AS chi_square,
    round(exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6), 9) AS chi_square_p_value FROM
    (SELECT max(observations) AS observations, avg(abs_deviation) AS mad,
        sum(observations * pow(observed_share - expected_share, 2) / expected_share) AS x FROM tabled)""",
        digits=LEADING,
        tabled=DIGITS,
    ),
    "pearson_correlation": _with(
        ["claims"],
        _correlated("pearson_r", "pearson_p_value", 9, f"SELECT corr({X}, {Y}) AS r, count(*) AS n FROM claims"),
    ),
    "spearman_correlation": _with(
        ["claims"],
        _correlated("spearman_rho", "spearman_p_value", 9, "SELECT corr(rx, ry) AS r, count(*) AS n FROM ranked"),
        ranked="""SELECT rank() OVER (ORDER BY VALUATION_USD) + (count(*) OVER (PARTITION BY VALUATION_USD) - 1) / 2 AS rx,
        rank() OVER (ORDER BY PAYOUT_AUTHORIZED) + (count(*) OVER (PARTITION BY PAYOUT_AUTHORIZED) - 1) / 2 AS ry
        FROM claims""",
    ),
    "fitted_line": _with(
        ["claims"],
        f"""SELECT round(regr_slope({Y}, {X}), 10) AS slope, round(regr_intercept({Y}, {X}), 4) AS intercept,
    round(regr_r2({Y}, {X}), 10) AS r_squared, count(*) AS observations FROM claims""",
    ),
}

# The written forest as SQL: the walk down each tree as nested cases, and the score of the mean path.
WALKS = """SELECT *, CASE WHEN PAYOUT_AUTHORIZED <= 40000.0 THEN CASE WHEN PREMIUM_SPIKE_USD <= 900.5 THEN 4.5 ELSE 3.0 END
        ELSE CASE WHEN ADJUSTER_GRATUITY <= 2500.25 THEN 2.5 ELSE 2.0 END END
    + CASE WHEN CAST(VALUATION_USD AS DOUBLE) <= 9000000.0
        THEN CASE WHEN CAST(TOTAL_FINANCIAL_DAMAGE_USD AS DOUBLE) <= 45000.75 THEN 4.0 ELSE 2.0 END
        ELSE CASE WHEN PAYOUT_TO_VALUE_RATIO <= 0.0015 THEN 3.5 ELSE 1.5 END END AS walked FROM {source}"""
SCORED = """SELECT *, 0.5 - pow(2, -CAST(walked AS DOUBLE) / 2 / (2 * (ln(7) + 0.5772156649015329) - 1.75)) AS s FROM walks"""
FLAG = "CASE WHEN s < 0 THEN -1 ELSE 1 END"


def _forest(source: str, body: str) -> str:
    return _with([source], body, walks=WALKS.format(source=source), scored=SCORED)


ORACLES |= {
    "sample_identities": _with(
        ["claims"],
        """SELECT least(1000, count(*)) AS size, least(1000, count(*)) AS distinct_rows, least(1000, count(*)) AS found FROM claims""",
    ),
    "correlations_with_a_constant": _with(
        ["claims"],
        """SELECT CAST(NULL AS DOUBLE) AS pearson_r, count(*) AS observations, CAST(NULL AS DOUBLE) AS pearson_p_value,
    CAST(NULL AS DOUBLE) AS spearman_rho, CAST(NULL AS DOUBLE) AS spearman_p_value FROM claims""",
    ),
    "welch_of_constant_cohorts": _with(
        ["claims"],
        f"""SELECT count(*) FILTER (WHERE DECODED_CONTRACTOR = {_text(COHORTS[0])}) AS first_count,
    count(*) FILTER (WHERE DECODED_CONTRACTOR = {_text(COHORTS[1])}) AS second_count,
    CAST(3 AS DOUBLE) AS first_mean, CAST(5 AS DOUBLE) AS second_mean, CAST(NULL AS DOUBLE) AS t_statistic,
    CAST(NULL AS DOUBLE) AS degrees_of_freedom, CAST(NULL AS DOUBLE) AS two_sided_p_value,
    CAST(NULL AS DOUBLE) AS one_sided_p_value, CAST(NULL AS BOOLEAN) AS significant_at_0_05 FROM claims""",
    ),
    "literal_forest_scores": _forest(
        "claims",
        f"""SELECT PROPERTY_ID, strftime(INCIDENT_DATE, '%Y-%m-%d %H:%M:%S') AS INCIDENT_DATE, MANAGER_ID,
    CAST({FLAG} AS BIGINT) AS isolation_forest_flag, round(s, 9) AS isolation_forest_score FROM scored""",
    ),
    "literal_forest_rate": _forest(
        "claims", "SELECT count(*) FILTER (WHERE s < 0) AS anomaly_count, round(count(*) FILTER (WHERE s < 0) / count(*), 12) AS anomaly_rate FROM scored"
    ),
    "literal_forest_countries": _forest(
        "claims", "SELECT COUNTRY_CODE, count(*) AS anomalies FROM scored WHERE s < 0 GROUP BY COUNTRY_CODE"
    ),
    "literal_streamed_review": _forest(
        "portfolio",
        """SELECT PROPERTY_ID, strftime(INCIDENT_DATE, '%Y-%m-%d %H:%M:%S') AS INCIDENT_DATE, round(s, 9) AS isolation_forest_score
    FROM scored WHERE s < 0""",
    ),
}
ORACLES["insight_figures"] = f"""SELECT
    (SELECT round(t_statistic, 4) FROM ({ORACLES["welch_test"]})) AS t_statistic,
    (SELECT round(CAST(observations AS DOUBLE), 4) FROM ({ORACLES["benford_test"]})) AS benford_observations,
    (SELECT round(chi_square, 4) FROM ({ORACLES["benford_test"]})) AS chi_square,
    (SELECT round(pearson_r, 4) FROM ({ORACLES["pearson_correlation"]})) AS pearson_r,
    (SELECT round(spearman_rho, 4) FROM ({ORACLES["spearman_correlation"]})) AS spearman_rho,
    (SELECT round(CAST(count(*) AS DOUBLE), 4) FROM ({ORACLES["pareto_managers"]})) AS pareto_managers,
    (SELECT round(any_value(columns(*)), 4) FROM ({ORACLES["premium_deviation"]})) AS premium_mad,
    (SELECT round(CAST(count(*) AS DOUBLE), 4) FROM ({ORACLES["monthly_gratuity"]})) AS monthly_rows,
    (SELECT round(CAST(count(*) AS DOUBLE), 4) FROM ({ORACLES["daily_spike"]})) AS daily_rows,
    (SELECT round(CAST(count AS DOUBLE), 4) FROM ({ORACLES["payout_statistics"]})) AS payouts"""


# The grown forest as SQL: the same draws by md5, level by level, and every claim walked down every tree.
FEATURES = ["PAYOUT_AUTHORIZED", "PREMIUM_SPIKE_USD", "ADJUSTER_GRATUITY", "TOTAL_FINANCIAL_DAMAGE_USD", "PAYOUT_TO_VALUE_RATIO", "VALUATION_USD"]
TREES, SAMPLE = 150, 256


def _key_text(key: list[str]) -> str:
    return " || '|' || ".join("strftime(INCIDENT_DATE, '%Y-%m-%d %H:%M:%S')" if c == "INCIDENT_DATE" else f"CAST({c} AS VARCHAR)" for c in key)


def _grown_tables(source: str, key: list[str]) -> dict[str, str]:
    every = range(1, len(FEATURES) + 1)
    tables = {
        "keyed": f"""SELECT *, row_number() OVER () AS rid, md5('42:' || {_key_text(key)}) AS h,
    [{", ".join(f"CAST({c} AS DOUBLE)" for c in FEATURES)}] AS f FROM {source}""",
        "pool": f"SELECT h, f FROM keyed ORDER BY h LIMIT {TREES * SAMPLE}",
        "size": f"SELECT least({SAMPLE}, count(*)) AS points, ceil(log2(greatest(least({SAMPLE}, count(*)), 2))) AS depth FROM keyed",
        "s0": f"""SELECT tree, f, 0 AS node FROM (SELECT tree, f, row_number() OVER (PARTITION BY tree
    ORDER BY md5(CAST(tree AS VARCHAR) || ':' || h), h) AS place FROM pool, range({TREES}) AS t(tree)) WHERE place <= {SAMPLE}""",
    }
    for level in range(9):
        tables[f"b{level}"] = f"""SELECT *, list_filter(range(0, {len(FEATURES)}), lambda i: high[i + 1] > low[i + 1]) AS varied,
    md5('42:' || CAST(tree AS VARCHAR) || ':' || CAST(node AS VARCHAR)) AS draw FROM (
    SELECT tree, node, count(*) AS points, [{", ".join(f"min(f[{i}])" for i in every)}] AS low, [{", ".join(f"max(f[{i}])" for i in every)}] AS high
    FROM s{level} GROUP BY tree, node)"""
        tables[f"d{level}"] = f"""SELECT tree, node, points, leaf, feature, CASE WHEN leaf THEN NULL WHEN cut >= hi THEN lo ELSE cut END AS threshold
    FROM (SELECT *, lo + CAST(CAST('0x' || substr(draw, 9, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 * (hi - lo) AS cut FROM (
    SELECT *, low[feature + 1] AS lo, high[feature + 1] AS hi FROM (
    SELECT *, CASE WHEN leaf THEN 0 ELSE varied[CAST('0x' || substr(draw, 1, 8) AS BIGINT) % len(varied) + 1] END AS feature FROM (
    SELECT *, points <= 1 OR len(varied) = 0 OR {level} >= (SELECT depth FROM size) AS leaf FROM b{level}))))"""
        tables[f"s{level + 1}"] = f"""SELECT s.tree, s.f, 2 * s.node + CASE WHEN s.f[d.feature + 1] <= d.threshold THEN 1 ELSE 2 END AS node
    FROM s{level} AS s JOIN d{level} AS d ON s.tree = d.tree AND s.node = d.node WHERE NOT d.leaf"""
    levels = " UNION ALL ".join(f"SELECT * FROM d{level}" for level in range(9))
    tables["forest"] = f"""SELECT *, CASE WHEN leaf THEN floor(log2(node + 1.5)) + CASE WHEN points <= 1 THEN 0.0 WHEN points = 2 THEN 1.0
    ELSE 2 * (ln(points - 1.0) + 0.5772156649015329) - 2 * (points - 1.0) / points END ELSE 0.0 END AS path FROM ({levels})"""
    return tables


def _grown(source: str, key: list[str], body: str) -> str:
    """SQL over ``scored``: the source's claims with ``s``, the decision value."""
    tables = _grown_tables(source, key)
    walked = f"SELECT rid, f, tree, CAST(0 AS BIGINT) AS node FROM keyed, range({TREES}) AS t(tree)"
    for _ in range(8):
        walked = f"""SELECT w.rid, w.f, w.tree, CASE WHEN d.leaf THEN w.node WHEN w.f[d.feature + 1] <= d.threshold THEN 2 * w.node + 1
    ELSE 2 * w.node + 2 END AS node FROM ({walked}) AS w JOIN forest AS d ON w.tree = d.tree AND w.node = d.node"""
    tables["paths"] = f"SELECT w.rid, sum(d.path) AS total FROM ({walked}) AS w JOIN forest AS d ON w.tree = d.tree AND w.node = d.node GROUP BY w.rid"
    tables["scored"] = f"""SELECT keyed.*, 0.5 - pow(2, -total / {TREES} / (SELECT CASE WHEN points = 2 THEN 1.0
    ELSE 2 * (ln(points - 1.0) + 0.5772156649015329) - 2 * (points - 1.0) / points END FROM size)) AS s FROM keyed JOIN paths ON keyed.rid = paths.rid"""
    return _with([source], body, **tables)


ANOMALY_SPEC = """PROPERTY_ID @INCIDENT_DATE MANAGER_ID ADJUSTER_ID COUNTRY_CODE PROPERTY_TYPE DECODED_CONTRACTOR $PAYOUT_AUTHORIZED
$PREMIUM_SPIKE_USD $ADJUSTER_GRATUITY $TOTAL_FINANCIAL_DAMAGE_USD $PAYOUT_TO_VALUE_RATIO $VALUATION_USD"""
ANOMALIES = f"SELECT {_columns(ANOMALY_SPEC)}, round(s, 9) AS isolation_forest_score FROM scored WHERE s < 0"
ORACLES |= {
    "forest_nodes": _with(
        ["claims"],
        """SELECT tree, node, feature, threshold, CASE WHEN leaf THEN node ELSE 2 * node + 1 END AS low,
    CASE WHEN leaf THEN node ELSE 2 * node + 2 END AS high, round(path, 9) AS path, (SELECT points FROM size) AS sample FROM forest""",
        **_grown_tables("claims", FOREST_KEY),
    ),
    "anomaly_scores": _grown("claims", FOREST_KEY, ANOMALIES),
    "anomaly_rate": _grown(
        "claims", FOREST_KEY, "SELECT count(*) FILTER (WHERE s < 0) AS anomaly_count, round(count(*) FILTER (WHERE s < 0) / count(*), 12) AS anomaly_rate FROM scored"
    ),
    "anomalies_by_country": _grown("claims", FOREST_KEY, "SELECT COUNTRY_CODE, count(*) AS anomalies FROM scored WHERE s < 0 GROUP BY COUNTRY_CODE"),
    "streamed_review": _grown("portfolio", ["PROPERTY_ID", "INCIDENT_DATE"], ANOMALIES),
    "fixed_sample": _with(
        ["claims"],
        f"""SELECT PROPERTY_ID, strftime(INCIDENT_DATE, '%Y-%m-%d %H:%M:%S') AS INCIDENT_DATE, MANAGER_ID, ADJUSTER_ID,
    {_columns("$PAYOUT_AUTHORIZED $ADJUSTER_GRATUITY $PREMIUM_SPIKE_USD $VALUATION_USD")}
    FROM claims ORDER BY md5('42:' || {_key_text(FOREST_KEY)}) LIMIT 50000""",
    ),
}
ORACLES |= {
    "incremental_trackers": _with(
        ["claims"],
        """SELECT 'adjuster' AS kind, adjuster_id AS tracked, CAST(total_authorized_payouts AS DOUBLE) AS payout,
    CAST(total_bribes AS DOUBLE) AS measure, CAST(unique_shell_companies AS BIGINT) AS number FROM adjusters
    UNION ALL SELECT 'contractor', contractor, CAST(total_payout_stolen AS DOUBLE), avg_premium_spike, CAST(total_incidents AS BIGINT) FROM contractors""",
        **_trackers("claims"),
    ),
    "suspect_network": _with(
        ["suspects"],
        """SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM (WITH RECURSIVE walk(root, node, depth) USING KEY (root, node) AS (
    SELECT MANAGER_ID, MANAGER_ID, 0 FROM roots UNION
    SELECT walk.root, b, min(walk.depth) + 1 FROM walk JOIN edges ON walk.node = a
    LEFT JOIN recurring.walk AS known ON known.root = walk.root AND known.node = b WHERE known.node IS NULL GROUP BY walk.root, b)
    SELECT * FROM walk) GROUP BY root, node""",
        edges="""SELECT DISTINCT a, b FROM (SELECT MANAGER_ID AS a, ADJUSTER_ID AS b FROM suspects UNION ALL
    SELECT ADJUSTER_ID, PROPERTY_ID FROM suspects UNION ALL SELECT PROPERTY_ID, MANAGER_ID FROM suspects)""",
        roots="SELECT MANAGER_ID FROM suspects GROUP BY MANAGER_ID ORDER BY sum(TOTAL_FINANCIAL_DAMAGE_USD) DESC, MANAGER_ID LIMIT 5",
    ),
    "event_time_totals": _with(
        ["claims"],
        """SELECT ADJUSTER_ID, count(*) FILTER (WHERE NOT late) AS claims, CAST(coalesce(sum(PHANTOM_CLAIM_SUSPECT) FILTER (WHERE NOT late), 0) AS BIGINT) AS suspects,
    CAST(sum(PAYOUT_AUTHORIZED) FILTER (WHERE NOT late) AS DOUBLE) AS payout,
    strftime(max(INCIDENT_DATE) FILTER (WHERE NOT late), '%Y-%m-%d %H:%M:%S') AS last_incident,
    count(*) FILTER (WHERE late) AS late_claims, CAST(sum(PAYOUT_AUTHORIZED) FILTER (WHERE late) AS DOUBLE) AS late_payout
    FROM judged GROUP BY ADJUSTER_ID""",
        arrived=f"SELECT *, {ARRIVAL} AS batch FROM claims",
        judged="""SELECT *, coalesce(INCIDENT_DATE < (SELECT max(b.INCIDENT_DATE) FROM arrived AS b WHERE b.batch < arrived.batch) - INTERVAL 30 DAYS, false)
    AS late FROM arrived""",
    ),
}
ORACLES |= {
    "backfill_in_place": ORACLES["country_backfill"],
    "loaded_table": ORACLES["nan_to_null"],
    "column_types": _with(
        ["claims"],
        "\nUNION ALL\n".join(
            f"SELECT '{c}' AS column_name, CAST({k} AS BIGINT) AS position, '{t}' AS data_type, count({c}) AS filled FROM claims"
            for k, (c, t) in enumerate(
                [
                    ("PROPERTY_ID", "string"),
                    ("INCIDENT_DATE", "timestamp_ntz"),
                    ("VALUATION_LOCAL", "decimal(18,2)"),
                    ("YEAR", "int"),
                    ("DECODED_CONTRACTOR", "string"),
                    ("PAYOUT_TO_VALUE_RATIO", "double"),
                ]
            )
        ),
    ),
}
ORACLES["merged_profile"] = _with(
    ["claims"],
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, min(CAST({c} AS VARCHAR)) AS min_text,
    max(CAST({c} AS VARCHAR)) AS max_text, {f"min(CAST({c} AS DOUBLE))" if n else "CAST(NULL AS DOUBLE)"} AS min_number,
    {f"max(CAST({c} AS DOUBLE))" if n else "CAST(NULL AS DOUBLE)"} AS max_number, {f"round({_mean(c)}, 4)" if n else "CAST(NULL AS DOUBLE)"} AS mean,
    count(DISTINCT {c}) AS distinct_count, true AS distinct_close FROM claims"""
        for c, n in ((c, c in ("SQUARE_FOOTAGE", "VALUATION_LOCAL", "PAYOUT_AUTHORIZED")) for c in PROFILED)
    ),
)
