"""Relationship paths manager -> incident -> adjuster -> contractor of suspect claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.operators.ordered import stored
from claimlens.operators.summary import suspects


def incident_node(property_id: Column, date: Column) -> Column:
    return F.concat_ws("@", property_id, F.coalesce(date.cast("string"), F.lit("undated")))


def relationship_edges(df: DataFrame) -> DataFrame:
    """Edges of suspect claims. Each carries its incident, so that an adjuster's claims keep apart."""
    node = incident_node(F.col("PROPERTY_ID"), F.col("INCIDENT_DATE"))
    hops = [
        ("manager", F.col("MANAGER_ID"), "incident", node),
        ("incident", node, "adjuster", F.col("ADJUSTER_ID")),
        ("adjuster", F.col("ADJUSTER_ID"), "contractor", F.col("DECODED_CONTRACTOR")),
    ]
    edges = F.array(
        *[
            F.struct(
                F.lit(from_type).alias("from_type"),
                source.alias("from_node"),
                F.lit(to_type).alias("to_type"),
                target.alias("to_node"),
            )
            for from_type, source, to_type, target in hops
        ]
    )
    claims = suspects(df).select(node.alias("incident"), F.col("PAYOUT_AUTHORIZED").alias("payout"), edges.alias("e"))
    linked = claims.select("incident", "payout", F.inline("e"))
    return linked.filter(F.col("from_node").isNotNull() & F.col("to_node").isNotNull())


def walk(edges: DataFrame, root_type: str = "manager", max_depth: int = 3) -> DataFrame:
    """Paths from the root nodes along the edges of one incident, each node at most once per path.

    One equi-join on (incident, node) per level, each computed once and stored. The key is nearly unique, so no level
    has a hot key, and unlike a recursive query there is no limit on the rows of a level.
    """
    roots = edges.filter(F.col("from_type") == root_type)
    level = roots.select(
        "incident",
        "payout",
        F.col("from_node").alias("root"),
        F.lit(0).alias("depth"),
        F.col("from_node").alias("node"),
        F.col("from_type").alias("node_type"),
        F.array("from_node").alias("visited"),
    )
    level = stored(level.distinct())
    levels = [level]
    steps = edges.select(
        F.col("incident").alias("_incident"), F.col("from_type"), F.col("from_node"), F.col("to_type"), F.col("to_node")
    )
    steps = stored(steps.distinct())
    for _ in range(max_depth):
        met = (
            (F.col("incident") == F.col("_incident"))
            & (F.col("node") == F.col("from_node"))
            & (F.col("node_type") == F.col("from_type"))
        )
        level = stored(
            level.join(steps, met)
            .filter(~F.array_contains("visited", F.col("to_node")))
            .select(
                "incident",
                "payout",
                "root",
                (F.col("depth") + 1).alias("depth"),
                F.col("to_node").alias("node"),
                F.col("to_type").alias("node_type"),
                F.concat("visited", F.array("to_node")).alias("visited"),
            )
        )
        levels.append(level)
    paths = levels[0]
    for deeper in levels[1:]:
        paths = paths.unionByName(deeper)
    return paths.withColumn("path", F.array_join("visited", " -> ")).drop("visited")


def claim_paths(df: DataFrame) -> DataFrame:
    """Every path of :func:`walk` for claims with one row per incident, without a join.

    All edges of an incident then come from its one row, so the walk never leaves the row: a path ends at
    the first missing node.
    """
    node = incident_node(F.col("PROPERTY_ID"), F.col("INCIDENT_DATE"))
    kinds = ["manager", "incident", "adjuster", "contractor"]
    nodes = [F.col("MANAGER_ID"), node, F.col("ADJUSTER_ID"), F.col("DECODED_CONTRACTOR")]
    steps = []
    for depth, kind in enumerate(kinds):
        so_far = nodes[: depth + 1]
        whole = F.lit(True)
        for n in so_far:
            whole = whole & n.isNotNull()
        steps.append(
            F.when(
                whole,
                F.struct(
                    F.lit(depth).alias("depth"),
                    nodes[depth].alias("node"),
                    F.lit(kind).alias("node_type"),
                    F.concat_ws(" -> ", *so_far).alias("path"),
                ),
            )
        )
    claims = suspects(df).select(
        node.alias("incident"),
        F.col("PAYOUT_AUTHORIZED").alias("payout"),
        F.col("MANAGER_ID").alias("root"),
        F.filter(F.array(*steps), lambda s: s.isNotNull()).alias("s"),
    )
    return claims.filter(F.col("root").isNotNull()).select("incident", "payout", "root", F.inline("s"))


def relationship_concentration(df: DataFrame, above: int = 1) -> DataFrame:
    """Manager, adjuster and contractor triples that share more than ``above`` suspect claims."""
    triple = ["MANAGER_ID", "ADJUSTER_ID", "DECODED_CONTRACTOR"]
    return (
        suspects(df)
        .groupBy(*triple)
        .agg(F.count(F.lit(1)).alias("claims"), F.sum("PAYOUT_AUTHORIZED").alias("total_payout"))
        .filter(F.col("claims") > above)
        .orderBy(F.col("claims").desc(), F.col("total_payout").desc(), *triple)
    )


def network_edges(df: DataFrame) -> DataFrame:
    """Distinct edges between people and properties of suspect claims, whatever the incident: manager -> adjuster ->
    property -> manager. The network has cycles."""
    hops = [("MANAGER_ID", "ADJUSTER_ID"), ("ADJUSTER_ID", "PROPERTY_ID"), ("PROPERTY_ID", "MANAGER_ID")]
    pairs = F.array(*[F.struct(F.col(a).alias("from_node"), F.col(b).alias("to_node")) for a, b in hops])
    rows = suspects(df).select(F.inline(pairs))
    return rows.filter(F.col("from_node").isNotNull() & F.col("to_node").isNotNull()).distinct()


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Every ``node`` that each ``root`` reaches along the edges, itself included, with the fewest steps (``depth``).

    A semi-naive walk to the fixed point: each round joins only the nodes found in the last one with the edges, and keeps
    those not known yet, so cycles end it and there is no limit of depth. A pair of root and node is found once, however
    many paths lead to it; duplicates are dropped before the shuffle, and a hub's edges can be split by adaptive
    execution. Every round is stored, so the plan does not grow with the depth. Repeated edges and loops are harmless,
    missing nodes reach nothing.
    """
    steps = stored(edges.select(F.col("from_node").alias("_from"), F.col("to_node").alias("_to")).where("_from IS NOT NULL AND _to IS NOT NULL").distinct())
    start = roots.toDF("root").where("root IS NOT NULL").distinct()
    rounds = [stored(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))]
    known = rounds[0]
    while True:
        met = rounds[-1].join(steps, F.col("node") == F.col("_from")).select("root", F.col("_to").alias("node")).distinct()
        fresh = stored(met.join(known, ["root", "node"], "left_anti").withColumn("depth", F.lit(len(rounds))))
        if fresh.isEmpty():
            return known
        rounds.append(fresh)
        known = known.unionByName(fresh)
