"""Exact quantiles by rank, without sorting or gathering a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import written


def _ranks(kind: str, p: float) -> dict[str, Column]:
    """0-based ranks that a quantile of ``n`` values needs."""
    n = F.col("n")
    if kind == "disc":  # the least value that at least a share p doesn't exceed
        return {"at": F.greatest(F.lit(0), F.ceil(n * p) - 1)}
    if kind == "rounded":
        return {"at": F.bround((n - 1) * p).cast("long")}
    if kind == "floor":
        return {"at": F.least(F.floor(n * p), n - 1)}
    return {"at": F.floor((n - 1) * p), "next": F.ceil((n - 1) * p)}  # cont: between two values


def exact_quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``(by..., name...)``: quantiles of the values of each group, each by its own definition: disc, cont, rounded or floor.

    Values are counted with map-side combine and range-partitioned with their
    group; ranks are sums within the partition plus what the partitions before it
    hold, and only the partitions that hold a wanted rank are looked at. Null
    values are left out; a group without values gives no row.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    spread = written(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    parts = spread.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # one row for each group and partition: small
    parts = parts.withColumn("_from", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).withColumn("n", F.sum("_size").over(W.partitionBy(*by)))
    ends = F.array(*(F.struct(F.lit(f"{name} {k}").alias("k"), at.cast("long").alias("rank")) for name, (kind, p) in wanted.items() for k, at in _ranks(kind, p).items()))
    goals = parts.select(*by, "_part", "_from", "_size", F.explode(ends).alias("_g")).filter("_g.rank >= _from and _g.rank < _from + _size")
    upto = F.sum("_n").over(W.partitionBy(*by, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    near = spread.join(goals.select(*by, "_part").distinct(), [*by, "_part"], "left_semi").withColumn("_upto", upto)
    met = near.join(goals, [*by, "_part"]).filter(F.col("_from") + F.col("_upto") > F.col("_g.rank"))
    # the first value whose running count passes the rank; all share of the gap for those between two values
    found = met.groupBy(*by, "_g.k").agg(F.min("_v").alias("v"))
    pick = lambda key: F.max(F.when(F.col("k") == key, F.col("v")))
    table = found.groupBy(*by).agg(*(pick(f"{name} {k}").alias(f"{name} {k}") for name, (kind, p) in wanted.items() for k in _ranks(kind, p)))
    sizes = parts.groupBy(*by).agg(F.max("n").alias("n"))

    def settled(name: str, kind: str, p: float) -> Column:
        low = F.col(f"{name} at")
        if kind != "cont":
            return low.alias(name)
        share = (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p)
        return (low + (F.col(f"{name} next") - low) * share).alias(name)

    return table.join(sizes, by).select(*by, *(settled(name, kind, p) for name, (kind, p) in wanted.items()))


def joined(frames: list[DataFrame], by: list[str]) -> DataFrame:
    """Left joins of the frames on their group."""
    return reduce(lambda x, y: x.join(y, by, "left"), frames)
