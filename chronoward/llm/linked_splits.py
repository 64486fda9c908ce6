"""Splits that keep linked records together.

Records that share an entity, directly or through other records, form one
component, found by alternating large-star and small-star steps on the bipartite
graph of entities; the hash of the component picks its split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoward.session import broadcast_if_small, checkpoint


def _with_least(links: DataFrame, n_links: int, hub_links: int, salts: int) -> DataFrame:
    """``links(u, v)`` plus ``m``, the least of u and its neighbours.

    The links of a hub (more than ``hub_links`` of them) are salted over ``salts``
    tasks, to each of which the hub's one-row minimum is copied. There are at most
    ``n_links / hub_links`` hubs.
    """
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    if n_links <= hub_links:  # no node can be a hub
        return links.join(least.drop("n"), "u")
    least = checkpoint(least)
    hubs = least.filter(F.col("n") > hub_links).select("u", F.lit(True).alias("hub"))
    salted = (
        links.join(broadcast_if_small(hubs, n_links // hub_links + 1), "u", "left")
        .withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(salts))).otherwise(0).cast("long"))
    )
    copies = F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > hub_links, F.lit(salts - 1)).otherwise(0).cast("long"))
    return salted.join(least.select("u", "m", F.explode(copies).alias("salt")), ["u", "salt"]).select("u", "v", "m")


def connected_components(
    edges: DataFrame, max_rounds: int = 50, hub_links: int = 100_000, salts: int = 64
) -> DataFrame:
    """``node, component``: each node of ``edges(u, v)`` with the least node of its component.

    Self-loops keep isolated nodes; null ends are ignored. Every round is one large
    star and one small star; only the number of edges and a checksum reach the
    driver, and a reliable checkpoint cuts the lineage. A node with more than
    ``hub_links`` links is spread over ``salts`` tasks.
    """
    clean = edges.filter("u is not null and v is not null").select("u", "v")
    nodes = clean.select(F.col("u").alias("node")).union(clean.select(F.col("v").alias("node"))).distinct()
    links = checkpoint(
        clean.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    n_links = links.count()
    seen = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u goes to u's least neighbour
        large = (
            _with_least(both, 2 * n_links, hub_links, salts).filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: u and its smaller neighbours go to the least of them
        starred = _with_least(large, 2 * n_links, hub_links, salts)
        links = checkpoint(
            starred.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        )
        n_links, total = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n_links, total) == seen:
            break
        seen = (n_links, total)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def assign_splits(
    df: DataFrame, record: str, entities: list[Column], proportions: list[tuple[str, float]], seed: int = 0
) -> DataFrame:
    """``record, group_key, split_label`` for each distinct record id.

    ``entities`` are string columns; records that share a value in the same column
    belong together, and so on through shared records. A null entity links nothing;
    a record without any entity is a group of its own. Proportions are normalised;
    the hash (md5, the same everywhere) of the group key falls into one of their ranges.
    """
    tagged = [F.when(e.isNotNull(), F.concat(F.lit(f"{i}:"), e.cast("string"))) for i, e in enumerate(entities)]
    rows = df.select(F.col(f"`{record}`").alias("id"), *[t.alias(f"e{i}") for i, t in enumerate(tagged)])
    rows = rows.filter("id is not null").distinct()
    names = [f"e{i}" for i in range(len(entities))]
    head = F.coalesce(*names, F.concat(F.lit("r:"), F.col("id").cast("string")))
    # a record seen in several rows ties all its entities together
    per_record = rows.groupBy("id").agg(F.min(head).alias("u"))
    edges = rows.withColumn("v", F.explode(F.array_compact(F.array(head, *names)))).join(per_record, "id").select("u", "v")
    components = connected_components(edges.distinct())
    total = sum(p for _, p in proportions)
    digits = F.substring(F.md5(F.concat(F.col("component"), F.lit(f"#{seed}"))), 1, 8)
    x = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))
    label, reached = F.lit(proportions[-1][0]), 0.0
    bounds = []
    for name, share in proportions:
        reached += share / total
        bounds.append((name, reached))
    for name, bound in reversed(bounds[:-1]):
        label = F.when(x < bound, F.lit(name)).otherwise(label)
    return per_record.join(components, F.col("u") == F.col("node")).select(
        F.col("id").alias(record), F.col("component").alias("group_key"), label.alias("split_label")
    )
