"""Exact order-dependent operators that never put one whole group, or the whole table, into one task.

The rows are range-partitioned on the full ordering, so a hot key spreads over as many ranges as its share
of the rows needs. Each range is worked on locally and a small per-range carry (one row per range that
starts inside a group) links neighbouring ranges. Rows are stored by column before they are ranged; wide rows
then find their range by comparing with the limits and move once, to the window that works on it. There is one
path for every size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.session import scratch_path, shared_folder

RANGE = "_range"

# A quantile is searched in a rank interval of this half-width, as a share of the rows. The sketches that place
# the interval are off by at most 1 / ACCURACY and, each of them, by one row; where the rows are so few that the
# half-width does not cover both, the interval ends at the least and the greatest value.
RANK_MARGIN = 2e-3
ACCURACY = 2_000

# Keys that place the limits of ranges and tiles, and how far from its expected place among them a tile's limit is
# looked for, in standard deviations. Neither touches the result.
SAMPLED = 100_000
DEVIATIONS = 5


def ascending(*names: str) -> list[Column]:
    """Ascending sort with missing values last."""
    return [F.col(n).asc_nulls_last() for n in names]


def ordered_ranges(
    df: DataFrame, order: Sequence[Column], ranges: int | None = None, row_id: str | None = None
) -> DataFrame:
    """Narrow rows tagged with the id of the contiguous range of ``order`` they lie in, computed once and stored.

    Without ``ranges`` the number of ranges follows the shuffle settings and adaptive coalescing. ``row_id``
    adds a number unique to each row; it is given after the shuffle and stored, so it never changes.
    """
    kept = stored_by_column(df)
    spread = kept.repartitionByRange(ranges, *order) if ranges else kept.repartitionByRange(*order)
    tagged = spread.withColumn(RANGE, F.spark_partition_id())
    if row_id:
        tagged = tagged.withColumn(row_id, F.monotonically_increasing_id())
    return stored(tagged)


def _sampled_keys(keys: DataFrame, order: Sequence[str], total: int) -> tuple[DataFrame, int]:
    """About ``SAMPLED`` of the ordering keys, numbered in order, and their number. They only place limits, which may lie
    anywhere: every row is then compared with them."""
    share = min(1.0, SAMPLED / max(total, 1))
    some = stored(keys.sample(share, 1) if share < 1 else keys)
    # One task numbers these few keys, whatever the size of the data.
    return some.withColumn("_place", F.row_number().over(Window.orderBy(*ascending(*order)))), some.count()


def _limits_at(sampled: DataFrame, order: Sequence[str], places: Sequence[int]) -> list[Column]:
    """The sampled keys at these places as ordering keys."""
    if not places:
        return []
    types = {f.name: f.dataType for f in sampled.schema.fields}
    rows = sampled.filter(F.col("_place").isin(list(places))).orderBy("_place").collect()
    return [_ordering_struct([_literal(r[c], types[c]) for c in order]) for r in rows]


def _with_range(df: DataFrame, order: Sequence[str], limits: Sequence[Column]) -> DataFrame:
    """The rows with the number of limits that lie below their key, found by halving."""
    compared = F.col("_order_key")

    def halved(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(compared <= limits[middle], halved(low, middle)).otherwise(halved(middle + 1, high))

    # An exploded key is made once for each row; any other would be made again for each comparison of a filter on the range.
    key = F.explode(F.array(_ordering_struct([F.col(c) for c in order])))
    keyed = df.select("*", key.alias("_order_key"))
    return keyed.withColumn(RANGE, halved(0, len(limits))).drop("_order_key")


def tagged_ranges(df: DataFrame, order: Sequence[str], ranges: int | None = None, is_stored: bool = False) -> DataFrame:
    """Wide rows, computed once and stored by column, with the id of their range of ``order`` (ascending, missing last).

    The limits of the ranges, as many as a shuffle has parts, are keys of a bounded sample; every row of the table finds
    its range by halving among them, so the rows themselves do not move. ``is_stored`` says that the rows come from a
    stored table already.
    """
    kept = df if is_stored else stored_by_column(df)
    keys = kept.select(*order)
    parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sampled, size = _sampled_keys(keys, order, keys.count())
    places = sorted({size * i // parts for i in range(1, parts)} - {0})
    return _with_range(kept, order, _limits_at(sampled, order, places))


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, for several readers."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored_by_column(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, for several readers of few columns each."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_lookup(lookup: DataFrame) -> DataFrame:
    """A join side stored by column, so that Spark knows its bytes and decides by its own threshold how to join."""
    return stored_by_column(lookup)


def _null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def attach_lookup(df: DataFrame, lookup: DataFrame, keys: Sequence[str], bounded: bool = False) -> DataFrame:
    """Left join on keys where null equals null.

    ``bounded`` marks a lookup whose size is proven small; any other is stored first. Rows with a null key that has
    no entry would all meet in one partition; adaptive execution splits it.
    """
    renamed = [f"_key_{k}" for k in keys]
    side = lookup.withColumnsRenamed(dict(zip(keys, renamed)))
    side = F.broadcast(side) if bounded else stored_lookup(side)
    return df.join(side, _null_safe(keys, renamed), "left").drop(*renamed)


def _earlier(group: Sequence[str]):
    return Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(
    df: DataFrame,
    values: dict[str, str],
    order: Sequence[Column],
    group: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """``sum(value) over (partition by group order by order rows unbounded preceding)`` per value -> output.

    For narrow rows and any ``order``, which should be total up to interchangeable rows.
    """
    ranged = ordered_ranges(df, [*ascending(*group), *order], ranges)
    return running_sum_in_ranges(ranged, values, order, group)


def running_sum_of_rows(
    df: DataFrame, values: dict[str, str], order: Sequence[str], group: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """:func:`running_sum` for wide rows in ascending order, which move once."""
    tagged = tagged_ranges(df, [*group, *order], ranges)
    return running_sum_in_ranges(tagged, values, ascending(*order), group)


def running_sum_in_ranges(
    ranged: DataFrame, values: dict[str, str], order: Sequence[Column], group: Sequence[str] = ()
) -> DataFrame:
    """:func:`running_sum` for rows already in ranges of (group, order).

    The carry has at most one row per range, since every (group, range) pair beyond the first of its group
    belongs to a range that starts inside the group.
    """
    sums = [F.sum(v).alias(f"_sum_{o}") for v, o in values.items()]
    carries = [F.sum(f"_sum_{o}").over(_earlier(group)).alias(f"_carry_{o}") for o in values.values()]
    place = F.row_number().over(Window.partitionBy(*group).orderBy(RANGE)).alias("_place")
    carry = (
        ranged.groupBy(*group, RANGE)
        .agg(*sums)
        .select(*group, RANGE, *carries, place)
        .filter(F.col("_place") > 1)
        .drop("_place")
    )
    local = Window.partitionBy(*group, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"_local_{o}": F.sum(v).over(local) for v, o in values.items()})
    joined = attach_lookup(summed, carry, [*group, RANGE], bounded=True)
    totals = {}
    for o in values.values():
        here, before = F.col(f"_local_{o}"), F.col(f"_carry_{o}")
        totals[o] = F.coalesce(here + before, here, before)
    helpers = [f"_{kind}_{o}" for o in values.values() for kind in ("local", "carry")]
    return joined.withColumns(totals).drop(*helpers, RANGE)


def next_in_group(
    df: DataFrame,
    columns: dict[str, str],
    group: Sequence[str],
    order: Sequence[str],
    ranges: int | None = None,
) -> DataFrame:
    """``lead(column) over (partition by group order by order)`` for each column -> output name.

    The last row of a group inside a range takes its successor from the first row of the group's next
    range; that table has at most one row per range.
    """
    ranged = tagged_ranges(df, [*group, *order], ranges)
    following = F.struct(*[F.col(c).alias(o) for c, o in columns.items()])
    rank_key = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    firsts = ranged.groupBy(*group, RANGE).agg(F.min_by(following, rank_key).alias("_first"))
    over_ranges = Window.partitionBy(*group).orderBy(RANGE)
    carry = (
        firsts.withColumn("_carry", F.lead("_first").over(over_ranges))
        .filter(F.col("_carry").isNotNull())
        .drop("_first")
    )
    local = Window.partitionBy(*group, RANGE).orderBy(*ascending(*order))
    led = attach_lookup(ranged.withColumn("_lead", F.lead(following).over(local)), carry, [*group, RANGE], True)
    successor = F.coalesce(F.col("_lead"), F.col("_carry"))
    return led.withColumns({o: successor[o] for o in columns.values()}).drop("_lead", "_carry", RANGE)


def value_positions(
    df: DataFrame,
    column: str,
    group: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Distinct values of a group with their count ``_n`` and the number of rows up to them, ``_upto``.

    Rows that stand for several carry their number in ``weight``.

    Ties collapse in the map-side part of the count, so a value held by a third of all rows costs one row
    per task. Missing values sort last ascending and first descending.
    """
    number = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*group, column).agg(number.alias("_n"))
    sort = F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()
    return running_sum(counts, {"_n": "_upto"}, [sort], group, ranges)


def rank_in_group(
    df: DataFrame, column: str, out: str, group: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """``rank() over (partition by group order by column desc)`` of an aggregate, which is stored first.

    It is ranked by way of its distinct values, so that neither a group nor a run of equal values has to fit one
    task.
    """
    kept = stored_by_column(df)
    positions = value_positions(kept, column, group, descending=True, ranges=ranges)
    ranks = positions.select(*group, column, (F.col("_upto") - F.col("_n") + 1).alias(out))
    return attach_lookup(kept, ranks, [*group, column])


def _quantile_bounds(clean: DataFrame, columns: Sequence[str], wanted: Sequence[float], group: Sequence[str]) -> DataFrame:
    """One row per group: for each column its count ``n`` and, per probability, the ends of its interval.

    Sketches are merged in as many parts as a shuffle has, so no task receives those of all splits. The least lower
    and the greatest upper end over the parts bound the quantile of the whole, if the margin covers one row of every
    part; else the extremes do.
    """
    parts = int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = [e for p in wanted for e in (max(0.0, p - RANK_MARGIN), min(1.0, p + RANK_MARGIN))]
    sketches = [
        F.struct(
            F.count(f"_c{i}").alias("n"),
            F.min(f"_c{i}").alias("least"),
            F.max(f"_c{i}").alias("most"),
            F.percentile_approx(f"_c{i}", ends, ACCURACY).alias("ends"),
        ).alias(f"_b{i}")
        for i in range(len(columns))
    ]
    part = (F.spark_partition_id() % parts).alias("_part")
    by_part = clean.select(*clean.columns, part).groupBy(*group, "_part").agg(*sketches)

    def merged(i: int) -> Column:
        b, n = F.col(f"_b{i}"), F.sum(f"_b{i}.n")
        trusted = n * (RANK_MARGIN - 1 / ACCURACY) > parts
        sides = []
        for k in range(len(ends)):
            pick, extreme = (F.max, F.max(b["most"])) if k % 2 else (F.min, F.min(b["least"]))
            sides.append(F.when(trusted, pick(b["ends"][k])).otherwise(extreme))
        return F.struct(n.alias("n"), F.array(*sides).alias("ends")).alias(f"_b{i}")

    return by_part.groupBy(*group).agg(*[merged(i) for i in range(len(columns))])


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    group: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles: one row per group and column, with ``n`` and array ``quantiles``.

    A first pass bounds each quantile by sketches. A second counts, in the same rows, the values below and between
    the intervals, and picks out only the values inside them, which are then counted one by one and ordered. Without
    groups the bounds are literals. Null and NaN do not take part.
    """
    keys = [*group, "column"]
    numbers = [F.col(c).cast("double") for c in columns]
    clean = df.select(*group, *[F.when(~F.isnan(x), x).alias(f"_c{i}") for i, x in enumerate(numbers)])
    wanted = sorted(set(probabilities))
    bounds = _quantile_bounds(clean, columns, wanted, group)
    if group:
        sided = attach_lookup(clean, bounds, group)
    else:
        row = bounds.first()  # one row, of a few numbers for each column
        literals = {}
        for i in range(len(columns)):
            sides = F.array(*[F.lit(x).cast("double") for x in row[f"_b{i}"]["ends"]])
            literals[f"_b{i}"] = F.struct(F.lit(row[f"_b{i}"]["n"]).cast("bigint").alias("n"), sides.alias("ends"))
        sided = clean.withColumns(literals)

    near, gap = [], []
    for i in range(len(columns)):
        value, sides = F.col(f"_c{i}"), F.col(f"_b{i}")["ends"]
        inside, beyond = F.lit(False), F.lit(0)
        for k in range(len(wanted)):
            inside = inside | value.between(sides[2 * k], sides[2 * k + 1])
            beyond = beyond + F.when(value > sides[2 * k + 1], 1).otherwise(0)
        near.append(value.isNotNull() & inside)
        gap.append(beyond)
    taken = [
        F.when(near[i], F.struct(F.lit(c).alias("column"), F.col(f"_b{i}")["n"].alias("n"), gap[i].alias("_gap"), F.col(f"_c{i}").alias("value")))
        for i, c in enumerate(columns)
    ]
    picked = sided.select(*group, F.inline(F.filter(F.array(*taken), lambda x: x.isNotNull())))
    singly = picked.groupBy(*keys, "n", "_gap", "value").agg(F.count(F.lit(1)).alias("_n"))
    # The far values of each gap are only counted: one row per group.
    far = [
        F.count_if(F.col(f"_c{i}").isNotNull() & ~near[i] & (gap[i] == g)).alias(f"_far{i}_{g}")
        for i in range(len(columns))
        for g in range(len(wanted) + 1)
    ]
    totals = [F.max(F.col(f"_b{i}")["n"]).alias(f"_n{i}") for i in range(len(columns))]
    gaps = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"_n{i}").alias("n"),
            F.lit(g).alias("_gap"),
            F.lit(None).cast("double").alias("value"),
            F.col(f"_far{i}_{g}").alias("_n"),
        )
        for i, c in enumerate(columns)
        for g in range(len(wanted) + 1)
    ]
    counted = sided.groupBy(*group).agg(*totals, *far).select(*group, F.inline(F.array(*gaps))).filter("_n > 0")
    # The far values of a gap lie below its near ones.
    order = [F.col("_gap").asc(), F.col("value").asc_nulls_first()]
    positions = running_sum(singly.unionByName(counted), {"_n": "_upto"}, order, [*keys, "n"], ranges)
    picks, found = [], {}
    for i, p in enumerate(wanted):
        at = (F.col("n") - 1) * F.lit(float(p))
        for end, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            inside = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(inside, F.col("value"))).alias(f"_{end}{i}"))
        below, above = F.col(f"_low{i}"), F.col(f"_high{i}")
        exact = below + (above - below) * (at - F.floor(at))
        missed = F.raise_error(F.lit("a quantile lies outside its estimated interval")).cast("double")
        found[p] = F.when(below.isNull() | above.isNull(), missed).otherwise(exact)
    return positions.groupBy(*keys, "n").agg(*picks).select(*keys, "n", F.array(*[found[p] for p in probabilities]).alias("quantiles"))


def exact_medians(df: DataFrame, columns: Sequence[str], ranges: int | None = None) -> dict[str, float | None]:
    """Exact median per column; the driver receives one number per column."""
    rows = exact_quantiles(df, columns, [0.5], ranges=ranges).collect()
    found = {r["column"]: r["quantiles"][0] for r in rows}
    return {c: found.get(c) for c in columns}


def _literal(value: Any, data_type: T.DataType) -> Column:
    """A literal of exactly this type; zone-free and decimal values go by way of their text."""
    if value is None:
        return F.lit(None).cast(data_type)
    if isinstance(data_type, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in data_type.fields])
    if isinstance(data_type, (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(str(value)).cast(data_type)
    return F.lit(value).cast(data_type)


def _ordering_struct(columns: Sequence[Column]) -> Column:
    """Struct that compares like an ascending sort with missing values last."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.struct(*[x.alias(f"k{i}") for i, x in enumerate(parts)])


def _range_sizes(ranged: DataFrame) -> list[tuple[int, int]]:
    """(range, rows) in range order; one row per range reaches the driver."""
    return sorted((r[RANGE], r["n"]) for r in ranged.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).collect())


def tile_limits(
    df: DataFrame, order: Sequence[str], tiles: int, ranges: int | None = None, is_stored: bool = False
) -> list[Column]:
    """Ordering keys of the last row of each tile but the last, for a total ascending order.

    A bounded sample tells between which keys each limit should lie. All rows are counted by these bounds where they
    lie; only those between two bounds that hold a limit are range-partitioned, and of their ranges only those holding
    one are numbered. A limit that lies elsewhere than expected makes for more such rows, not for another result.
    ``is_stored`` says that the rows come from a stored table already.
    """
    keys = df.select(*order) if is_stored else stored_by_column(df.select(*order))
    total = keys.count()
    base, extra = divmod(total, tiles)
    wanted = sorted({w for j in range(1, tiles) if 0 < (w := j * base + min(j, extra)) < total})
    if not wanted:
        return []
    sampled, size = _sampled_keys(keys, order, total)
    around = DEVIATIONS * size**0.5 / 2 + 1
    ends = {int(w / total * size + side * around) for w in wanted for side in (-1, 1)}
    bounded = _with_range(keys, order, _limits_at(sampled, order, sorted(e for e in ends if 0 < e <= size)))
    held, placed, seen, apart = [], [], 0, 0
    for part, n in _range_sizes(bounded):
        found = [w for w in wanted if seen < w <= seen + n]
        if found:
            held.append(part)
            placed += [w - apart for w in found]
        else:
            apart += n
        seen += n
    near = bounded.filter(F.col(RANGE).isin(held)).drop(RANGE)
    ranged = ordered_ranges(near, ascending(*order), ranges)
    places, seen = {}, 0
    for rng, n in _range_sizes(ranged):
        for w in placed:
            if seen < w <= seen + n:
                places.setdefault((rng, w - seen), w)
        seen += n
    local = Window.partitionBy(RANGE).orderBy(*ascending(*order))
    hit = reduce(lambda a, b: a | b, [(F.col(RANGE) == r) & (F.col("_rn") == i) for r, i in places])
    rows = (
        ranged.filter(F.col(RANGE).isin(sorted({r for r, _ in places})))
        .withColumn("_rn", F.row_number().over(local))
        .filter(hit)
        .collect()
    )
    rows.sort(key=lambda r: places[(r[RANGE], r["_rn"])])
    types = {f.name: f.dataType for f in keys.schema.fields}
    return [_ordering_struct([_literal(r[c], types[c]) for c in order]) for r in rows]


def with_tile(
    df: DataFrame,
    order: Sequence[str],
    tiles: int,
    out: str,
    limits: Sequence[Column] | None = None,
    source: DataFrame | None = None,
    is_stored: bool = False,
) -> DataFrame:
    """``ntile(tiles) over (order by order)`` without moving the rows: each compares itself to the limits.

    The limits are found over ``source``, by default ``df`` itself, which must hold the same rows; ``is_stored`` says
    that these come from a stored table already.
    """
    if limits is None:
        limits = tile_limits(df if source is None else source, order, tiles, is_stored=is_stored)
    key = _ordering_struct([F.col(c) for c in order])
    beyond = [F.when(key > limit, 1).otherwise(0) for limit in limits]
    return df.withColumn(out, reduce(lambda a, b: a + b, beyond, F.lit(1)))


def first_rows(df: DataFrame, order: Sequence[str], limit: int, ranges: int | None = None) -> DataFrame:
    """The first ``limit`` rows of an ordering, for limits too large to sort in one task."""
    ranged = ordered_ranges(df, ascending(*order), ranges)
    seen, whole, cut = 0, [], None
    for rng, n in _range_sizes(ranged):
        if seen + n <= limit:
            whole.append(rng)
            seen += n
        else:
            cut = (rng, limit - seen)
            break
    kept = ranged.filter(F.col(RANGE).isin(whole))
    if cut and cut[1] > 0:
        local = Window.partitionBy(RANGE).orderBy(*ascending(*order))
        part = ranged.filter(F.col(RANGE) == cut[0]).withColumn("_rn", F.row_number().over(local))
        kept = kept.unionByName(part.filter(F.col("_rn") <= cut[1]).drop("_rn"))
    return kept.drop(RANGE)


def row_key(key: Sequence[str]) -> Column:
    """The key columns as one text, a missing value as an empty one."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])


def seeded_digest(key: Sequence[str], seed: int) -> Column:
    """md5 of seed and row key: an order of the rows that is random, repeatable and known to SQL as well."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_key(key)))


def hex_digits(digest: Column, start: int, length: int) -> Column:
    """The number that some digits of a digest stand for."""
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def below_share(digest: Column, share: float) -> Column:
    """Whether a digest is among that share of all digests: a comparison of their texts."""
    return digest < F.lit(f"{int(share * 2**32):08x}") if share < 1 else F.lit(True)


def least_by_digest(df: DataFrame, digest: str, size: int, total: int) -> DataFrame:
    """The ``size`` rows of least digest. Rows that cannot be among them are dropped where they lie, by a threshold on
    the first digits that is raised until enough are left; the rest is stored."""
    wanted, slack = min(size, total), 1.0
    while True:
        share = min(1.0, slack * (wanted + 6 * wanted**0.5 + 20) / max(total, 1))
        near = stored(df.filter(below_share(F.col(digest), share)))
        if share >= 1 or near.count() >= wanted:
            return near.orderBy(digest).limit(wanted)
        slack *= 2


def fixed_sample(df: DataFrame, size: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``min(size, rows)`` rows, chosen by a digest of the row key and so alike for any partitioning.

    Rows equal in the key are told apart by nothing.
    """
    total = df.count()
    if total <= size:
        return df
    return least_by_digest(df.withColumn("_h", seeded_digest(key, seed)), "_h", size, total).drop("_h")
