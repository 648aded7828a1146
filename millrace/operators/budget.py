"""Budgets, quotas, samples and splits in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def largest_remainder(df: DataFrame, total: int | Column, weight: str, name: str, out: str = "quota", by: list[str] | None = None) -> DataFrame:
    """Allocate ``total`` by weight: floors first, then one more by fractional part (then name) descending. For small tables."""
    total = total if isinstance(total, Column) else F.lit(total)
    w = W.partitionBy(*(by or [F.lit(0)]))
    rows = df.withColumn("_x", total * F.col(weight)).withColumn("_f", F.floor(F.col("_x") + 1e-9).cast("long"))
    rows = rows.withColumn("_left", total - F.sum("_f").over(w))
    rank = F.row_number().over(w.orderBy(F.round(F.col("_x") - F.col("_f"), 9).desc(), F.col(name).desc()))
    return rows.withColumn(out, F.col("_f") + F.when(rank <= F.col("_left"), 1).otherwise(0)).drop("_x", "_f", "_left")


def floor_quotas(df: DataFrame, total: int, weight: str, name: str, out: str = "quota", by: list[str] | None = None) -> DataFrame:
    """Floors; the last by name gets what is left. For small tables."""
    w = W.partitionBy(*(by or [F.lit(0)]))
    rows = df.withColumn("_f", F.floor(F.lit(total) * F.col(weight) + 1e-9).cast("long")).withColumn("_last", F.max(name).over(w)).withColumn("_sum", F.sum("_f").over(w))
    return rows.withColumn(out, F.col("_f") + F.when(F.col(name) == F.col("_last"), F.lit(total) - F.col("_sum")).otherwise(0)).drop("_f", "_last", "_sum")


def take_budget(df: DataFrame, size: str, quota: int | Column, by: list[str], digest: Column) -> DataFrame:
    """Rows taken in hash order until the sum before them reaches the quota (the last may overshoot); adds ``before``.

    ``digest`` is a hex digest, so its first three digits cut each group into
    4,096 even bands: sizes are summed by band, and only the one band in which
    the quota ends is sorted. A group that holds a third of all rows never meets
    in one task.
    """
    rows = df.withColumn("_d", digest).withColumn("_band", F.substring("_d", 1, 3))
    sums = rows.groupBy(*by, "_band").agg(F.sum(size).alias("_size"))
    sums = sums.withColumn("_start", F.coalesce(F.sum("_size").over(W.partitionBy(*by).orderBy("_band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    rows = rows.join(sums, [*by, "_band"]).filter(F.col("_start") < quota)
    inside = F.coalesce(F.sum(size).over(W.partitionBy(*by, "_band").orderBy("_d").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", F.col("_start") + inside).filter(F.col("before") < quota).drop("_d", "_band", "_start")


def bottom_k(df: DataFrame, k: int, by: list[str], digest: Column) -> DataFrame:
    """The ``k`` rows of each stratum with the least digests: Spark keeps ``k`` a task before it shuffles."""
    return df.withColumn("_d", digest).withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("_d"))).filter(F.col("_n") <= k).drop("_d", "_n")


def hash_split(residue: Column, limits: list[tuple[str, int]], rest: str) -> Column:
    """Name of the first limit the residue is below, else ``rest``."""
    out = None
    for name, limit in limits:
        out = (F.when if out is None else out.when)(residue < limit, name)
    return out.otherwise(rest)


def ranked(df: DataFrame, out: str, *order: Column, by: list[str] | None = None) -> DataFrame:
    """A dense 0-based rank (within each group of ``by``) without sorting a table or group in one task.

    Rows are range-partitioned and sorted; ranks are places within the partition
    plus what the partitions before it hold of the group.
    """
    from ..runtime import written

    keys, by = list(order), by or []
    spread = written(df.repartitionByRange(*by, *keys).withColumn("_part", F.spark_partition_id()))
    within = F.row_number().over(W.partitionBy("_part", *by).orderBy(*keys)) - 1
    earlier = W.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # one row per partition and group: small, and broadcast only within the planner's limit
    offsets = spread.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return spread.withColumn("_w", within).join(offsets, ["_part", *by]).withColumn(out, (F.col("_w") + F.col("_off")).cast("long")).drop("_part", "_w", "_off")
