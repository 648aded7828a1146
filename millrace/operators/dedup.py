"""Exact de-duplication. All of it is aggregation with map-side combine, so groups of copies of any size are safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; rows with a null in the key are dropped.

    ``min_by`` over the whole row instead of a window: copies are combined before the shuffle.
    """
    rows = df.dropna(subset=key).withColumn("_row", F.struct(*df.columns)).withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return rows.groupBy(*key).agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def registry(df: DataFrame, digest: str, count: str, shard: str, line: str) -> DataFrame:
    """``(digest, token_count, occurrences, first_shard, first_line)`` of each digest and token count."""
    at = F.min(F.struct(F.col(shard).alias("s"), F.col(line).alias("l")))
    return df.groupBy(F.col(digest).alias("digest"), F.col(count).alias("token_count")).agg(F.count(F.lit(1)).alias("occurrences"), at.alias("at")).select("digest", "token_count", "occurrences", F.col("at.s").alias("first_shard"), F.col("at.l").alias("first_line"))


def origin_claims(df: DataFrame, origin: str, variant: str, claim: str) -> DataFrame:
    """The variant that claims each origin: the one with the least claim key."""
    return df.groupBy(origin).agg(F.min_by(variant, claim).alias(variant), F.min(claim).alias(claim))


def merged(df: DataFrame, key: str, *entries: str) -> DataFrame:
    """One row per key with the sorted distinct entries of its rows."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(*entries))).alias("entries"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)``: the smallest id reachable over the edges.

    Labels are hashed to the minimum over neighbours and then over the neighbours'
    labels (pointer jumping), so a path of n edges takes about log n rounds. Each
    round ends in the shared checkpoint folder.
    """
    from ..runtime import cut

    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    both = cut(both)
    labels = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("label").alias("other")), "y").groupBy("x").agg(F.min("other").alias("other"))
        step = labels.join(near, "x").select("x", F.least("label", "other").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("x").alias("low"), F.col("label").alias("lower"))
        new = cut(step.join(jump, "low", "left").select("x", F.least("low", F.coalesce("lower", "low")).alias("label"), "old"))
        if new.filter("label <> old").isEmpty():
            return new.select(F.col("x").alias("id"), F.col("label").alias("component"))
        labels = new.select("x", "label")


def greedy(rows: DataFrame, edges: DataFrame, order) -> DataFrame:
    """Ids kept when rows are taken in ``order(id)`` and one is dropped if a kept one is its neighbour.

    Every round settles all rows whose earlier neighbours are settled; edges are
    what is iterated, never the rows, and each round ends in the checkpoint folder.
    """
    from ..runtime import cut

    a, b = F.col("id_a"), F.col("id_b")
    first = order(a) < order(b)
    open_edges = cut(edges.select(F.when(first, a).otherwise(b).alias("early"), F.when(first, b).otherwise(a).alias("late")).distinct())
    gone = None
    while not open_edges.isEmpty():
        # rows without an open earlier neighbour are kept; their later neighbours go
        kept = open_edges.select("early").distinct().join(open_edges.select(F.col("late").alias("early")).distinct(), "early", "left_anti")
        out = cut(open_edges.join(kept, "early", "left_semi").select(F.col("late").alias("id")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        left = open_edges.join(kept, "early", "left_anti")
        left = left.join(out.select(F.col("id").alias("early")), "early", "left_anti").join(out.select(F.col("id").alias("late")), "late", "left_anti")
        open_edges = cut(left.select("early", "late"))
    return rows if gone is None else rows.join(gone.distinct(), "id", "left_anti")
