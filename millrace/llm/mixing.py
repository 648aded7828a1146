"""Mixing sources to target shares: weighted sampling without replacement by exponential keys.

Each record has the key -ln(u) / w with u from a hash of its id and w its quality
weight (Efraimidis and Spirakis); a unit (source or bucket) is taken in the
order of the keys until its size budget is reached. Where the budget is more
than the unit has, every record is first used once per complete epoch and only
the rest is selected.

No unit is ever sorted as a whole: keys fall into narrow logarithmic bands,
sizes are summed by band, and only the band in which the budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import written

#: Bands per doubling of the key; a band then has at most about 1 in 1,000 of a unit's records.
BANDS = 256
LEAST_WEIGHT, MOST_WEIGHT = 0.05, 1.0


def unit_name(column: Column) -> Column:
    """A source or bucket however it is written: trimmed, lower case, with underscores."""
    return F.lower(F.regexp_replace(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""), r"[-\s]+", "_"))


def text_quality(text: Column) -> Column:
    """Weight from 0.05 to 1 of a text, from what tells prose from noise; null and blank texts have the least.

    The product of: the share of letters and digits among visible characters;
    how many different words there are for its length (the logarithm of their
    number over that of all words, which hardly depends on length; texts without
    blanks between words count pairs of characters); how near its mean line is to
    full lines (short lines make menus and tables); and its length up to 200 characters.
    """
    visible = F.regexp_replace(text, r"(?U)\s+", "")
    length = F.greatest(F.length(visible), F.lit(1))
    letters = F.length(F.regexp_replace(visible, r"[^\p{L}\p{N}]", "")) / length
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    sparse = F.length(visible) > 12 * F.size(words)
    words = F.when(sparse, F.regexp_extract_all(visible, F.lit("(..)"), F.lit(1))).otherwise(words)
    variety = F.least(F.lit(1.0), F.log(F.size(F.array_distinct(words)) + 1.0) / F.greatest(F.log(F.size(words) + 1.0), F.lit(0.5)))
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    fullness = F.least(F.lit(1.0), F.lit(0.5) + F.length(visible) / F.greatest(lines, F.lit(1)) / 80.0)
    weight = letters * variety * fullness * F.least(F.lit(1.0), F.length(text) / 200.0)
    return F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.coalesce(weight, F.lit(LEAST_WEIGHT))))


def pretrain_units(records: DataFrame) -> DataFrame:
    """``(unit_kind, unit_id, record_key, size, weight)`` of pretraining records, by source.

    The size is ``loss_target_tokens``; where that is null, below 1 or not the
    input tokens less one it is mended from ``nonpad_input_tokens`` - 1, then
    from ``text_tokens`` + 1, then from a quarter of the characters.
    """
    loss, nonpad = F.col("loss_target_tokens"), F.col("nonpad_input_tokens")
    size = F.when((loss > 0) & (nonpad.isNull() | (loss == nonpad - 1)), loss).otherwise(
        F.when(nonpad > 1, nonpad - 1).otherwise(F.when(F.col("text_tokens") > 0, F.col("text_tokens") + 1).otherwise(F.greatest(F.lit(1), F.ceil(F.length("text") / 4))))
    )
    return records.select(F.lit("source").alias("unit_kind"), unit_name(F.col("source")).alias("unit_id"), F.col("candidate_id").alias("record_key"), F.coalesce(size, F.lit(1)).cast("long").alias("size"), text_quality(F.col("text")).alias("weight"))


def candidate_units(candidates: DataFrame) -> DataFrame:
    """The same of SFT candidates, by bucket; sized by ``valid_targets``, weighted by their share of the rendered tokens. Records without a positive size are left out."""
    share = F.try_divide(F.col("valid_targets"), F.col("rendered_tokens"))
    weight = F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.coalesce(share, F.lit(LEAST_WEIGHT))))
    rows = candidates.select(F.lit("bucket").alias("unit_kind"), unit_name(F.col("bucket")).alias("unit_id"), F.col("candidate_id").alias("record_key"), F.col("valid_targets").cast("long").alias("size"), weight.alias("weight"))
    return rows.filter("size > 0")


def keyed(units: DataFrame, seed: int = 0) -> DataFrame:
    """Each record once, with its exponential ``key`` and the ``band`` the key falls in; written to the shared folder."""
    rows = units.filter("unit_id is not null and record_key is not null and size > 0").dropDuplicates(["unit_kind", "record_key"])
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("record_key")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    weight = F.greatest(F.lit(1e-6), F.coalesce("weight", F.lit(1.0)))
    rows = rows.withColumn("key", -F.log(u) / weight)
    return written(rows.select("unit_kind", "unit_id", "record_key", "size", "key", F.floor(F.log2("key") * BANDS).cast("long").alias("band")))


def _plans(records: DataFrame, targets: DataFrame, total_size: int | None) -> tuple[DataFrame, DataFrame]:
    """Per mix and unit: budget, epochs and the remainder; and the sizes of the bands with what lies before each."""
    bands = records.groupBy("unit_kind", "unit_id", "band").agg(F.sum("size").alias("band_size"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("unit_kind", "unit_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    bands = bands.withColumn("before", F.coalesce(F.sum("band_size").over(before), F.lit(0)))
    has = bands.groupBy("unit_kind", "unit_id").agg(F.sum("band_size").alias("available"), F.sum("n").alias("n_records"))
    want = targets.select("mix_id", "unit_kind", unit_name(F.col("unit_id")).alias("unit_id"), "target_share", F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(1))).cast("long").alias("max_repeats"))
    plan = want.filter("mix_id is not null and unit_id is not null and target_share > 0").join(has, ["unit_kind", "unit_id"], "left").fillna(0, ["available", "n_records"])
    reach = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("available") * F.col("max_repeats") / F.col("target_share"))
    total = F.lit(total_size).cast("double") if total_size is not None else F.floor(F.coalesce(F.min(reach).over(W.partitionBy("mix_id")), F.lit(0.0)) + 1e-6).cast("double")
    plan = plan.withColumn("total", total).withColumn("budget", F.floor(F.col("total") * F.col("target_share") + 1e-6).cast("long"))
    plan = plan.withColumn("epochs", F.least("max_repeats", F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(F.lit(0).cast("long"))))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(F.lit(0).cast("long"))
    return plan.withColumn("rest", rest), bands


def uses(units: DataFrame, targets: DataFrame, total_size: int | None = None, seed: int = 0) -> DataFrame:
    """``(mix_id, unit_kind, unit_id, record_key, size, uses)``: how often each record of a mix's units is used.

    A record is used at most ``max_repeats`` times; sizes of the selected records
    of a unit never exceed its budget and fall short by less than the next
    record. ``total_size`` is the size of each mix; by default the largest at
    which every unit that has records can give its share. Units without
    records give nothing. ``targets`` is configuration: it must stay small, and
    it is what is broadcast (the planner checks its size). Equal keys are told
    apart by the record key. Repeated rows count once.
    """
    records = keyed(units, seed)
    plan, bands = _plans(records, targets, total_size)
    edge = plan.join(bands, ["unit_kind", "unit_id"]).filter("before <= rest and before + band_size > rest")
    edge = edge.groupBy("mix_id", "unit_kind", "unit_id").agg(F.max("band").alias("edge"), F.max("before").alias("before"))
    plan = written(plan.join(edge, ["mix_id", "unit_kind", "unit_id"], "left"))
    rows = records.join(plan.select("mix_id", "unit_kind", "unit_id", "epochs", "rest", "edge", "before"), ["unit_kind", "unit_id"])
    out = ["mix_id", "unit_kind", "unit_id", "record_key", "size", "uses"]
    clear = rows.filter("edge is null or band <> edge").withColumn("uses", F.col("epochs") + F.when(F.col("edge").isNotNull() & (F.col("band") < F.col("edge")), 1).otherwise(0))
    order = W.partitionBy("mix_id", "unit_kind", "unit_id").orderBy("key", "record_key").rowsBetween(W.unboundedPreceding, 0)
    cut = rows.filter("band = edge").withColumn("sum", F.sum("size").over(order))
    cut = cut.withColumn("uses", F.col("epochs") + F.when(F.col("before") + F.col("sum") <= F.col("rest"), 1).otherwise(0))
    return clear.select(*out).unionByName(cut.select(*out))


def shares(units: DataFrame, targets: DataFrame, total_size: int | None = None, seed: int = 0) -> DataFrame:
    """``(mix_id, unit_kind, unit_id, target_share, max_repeats, n_records, used_records, most_uses, available_size, unused_size, actual_size, actual_share)`` for every target.

    ``unused_size`` is the size of the records that aren't used at all: what a mix
    leaves behind because the smallest unit sets its size. Units without records have zeros.
    """
    got = uses(units, targets, total_size, seed).groupBy("mix_id", "unit_kind", "unit_id")
    got = got.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("uses") > 0).alias("used_records"), F.max("uses").alias("most_uses"), F.sum("size").alias("available_size"), F.sum(F.when(F.col("uses") == 0, F.col("size")).otherwise(0)).alias("unused_size"), F.sum(F.col("size") * F.col("uses")).alias("actual_size"))
    want = targets.select("mix_id", "unit_kind", unit_name(F.col("unit_id")).alias("unit_id"), "target_share", "max_repeats")
    rows = want.join(got, ["mix_id", "unit_kind", "unit_id"], "left").fillna(0, ["n_records", "used_records", "most_uses", "available_size", "unused_size", "actual_size"])
    whole = F.sum("actual_size").over(W.partitionBy("mix_id"))
    return rows.withColumn("actual_share", F.when(whole > 0, F.col("actual_size") / whole).otherwise(F.lit(0.0)))
