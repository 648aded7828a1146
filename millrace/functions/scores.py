"""Scores of answers, rewards, losses from given log-probabilities, bootstraps and generated tasks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X


def credit(a: Column, b: Column, tie: float = 1e-7) -> Column:
    """1 if b beats a, a half if they differ by no more than ``tie``, else 0."""
    return F.when(F.abs(a - b) <= tie, 0.5).when(b > a, 1.0).otherwise(0.0)


def bootstrap_means(rows: DataFrame, by: list[str], value: str, order: Column, replicates: int = 10_000) -> DataFrame:
    """``(by..., rep, mean)``: means of resamples with replacement of each stratum, drawn by hash, so that reruns agree.

    A draw is eight hex digits of a digest of stratum, replicate and eighth of
    the place: one digest gives eight draws. Draws of the same row are counted
    before they meet its value, so what is joined is no more than strata x rows.
    """
    from ..operators.budget import ranked

    placed = ranked(rows.select(*by, value, order.alias("_o")), "_k", F.col("_o"), by=by).select(*by, F.col("_k").alias("draw"), value)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    reps = rows.sparkSession.range(replicates).withColumnRenamed("id", "rep")
    blocks = sizes.crossJoin(reps).select(*by, "n", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 8"))).alias("block"))
    digest = F.sha2(F.concat_ws("|", *by, F.col("rep").cast("string"), F.col("block").cast("string")), 256)
    cells = F.transform(F.sequence(F.lit(0), F.least(F.lit(7).cast("long"), F.col("n") - 1 - F.col("block") * 8).cast("int")), lambda i: F.conv(F.substring(F.col("digest"), i * 8 + 1, F.lit(8)), 16, 10).cast("long") % F.col("n"))
    draws = blocks.withColumn("digest", digest).select(*by, "n", "rep", F.explode(cells).alias("draw"))
    counted = draws.groupBy(*by, "n", "rep", "draw").agg(F.count(F.lit(1)).alias("times"))
    return counted.join(placed, [*by, "draw"]).groupBy(*by, "rep").agg((F.sum(F.col(value) * F.col("times")) / F.max("n")).alias("mean"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many items of two arrays agree from the first on."""
    n = F.least(F.size(a), F.size(b))
    step = lambda acc, i: F.when((acc == i) & F.get(a, i).eqNullSafe(F.get(b, i)), acc + 1).otherwise(acc)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step)).otherwise(0)


def episode_reward(got: Column, want: Column) -> Column:
    """0.8 for all calls as wanted, and up to 0.2 for those right from the first on."""
    return 0.8 * (got == want).cast("int") + 0.2 * common_prefix(got, want) / F.greatest(F.size(want), F.lit(1))


def masked_sum(values: Column, mask: Column) -> Column:
    return F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x)


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float) -> Column:
    """-log sigmoid(beta x margin), the margin being that of the policy less that of the reference."""
    return F.log1p(F.exp(-beta * ((chosen - rejected) - (ref_chosen - ref_rejected))))


def policy_loss(new: Column, old: Column, ref: Column, mask: Column, advantage: Column, kind: str = "clipped", low: float = 0.2, high: float = 5.0, beta: float = 0.04) -> Column:
    """Mean over unmasked tokens of the policy loss: ratio clipped to 1 -+ ``low``, or clamped to at most ``high``; both less ``beta`` x divergence from the reference."""
    at = lambda i: (F.get(new, i), F.get(old, i), F.get(ref, i))

    def token(i: Column) -> Column:
        n, o, r = at(i)
        ratio, gap = F.exp(n - o), r - n
        divergence = F.exp(gap) - gap - 1
        if kind == "clipped":
            gain = F.least(ratio * advantage, F.greatest(F.lit(1 - low), F.least(F.lit(1 + low), ratio)) * advantage)
        else:
            gain = F.least(ratio, F.lit(high)) * advantage * n
        return -(gain - beta * divergence) * F.get(mask, i)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.size(new) - 1), token), F.lit(0.0), lambda a, x: a + x)
    return total / F.greatest(F.lit(1), F.aggregate(mask, F.lit(0), lambda a, x: a + x))


def number_in_text(t: Column, want: Column) -> Column:
    """The number stands in the text on its own (no letter, digit or point beside it); commas in numbers are ignored."""
    found = F.regexp_extract_all(F.replace(t, F.lit(","), F.lit("")), F.lit(r"(?:^|[^\w.+-])([-+]?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.exists(found, lambda x: F.abs(x.cast("double") - want) < 1e-6)


def exact(t: Column, want: str) -> Column:
    return t == want


def contains_any(t: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(t), w))


def contains_all(t: Column, words: tuple[str, ...]) -> Column:
    return F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(t), w))


def bullets(t: Column, n: int) -> Column:
    """Exactly n lines that aren't blank, all of them bullets."""
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) == n) & F.forall(lines, lambda x: F.startswith(x, F.lit("- ")))


def formula(t: Column, want: str) -> Column:
    return F.lower(F.replace(F.replace(t, F.lit("₂"), F.lit("2")), F.lit(" "), F.lit(""))) == want


def python_function(t: Column, head: str, body: str) -> Column:
    return F.contains(F.regexp_replace(t, r"\s+", " "), F.lit(head)) & t.rlike(body)


def short_with(t: Column, words: tuple[str, ...], most: int) -> Column:
    return F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)) & (F.length(t) <= most)


def generated_tasks(spark: SparkSession, n: int) -> DataFrame:
    """``(task_id, family, prompt, answer, split)``: tasks of ten families in turn, operands from the id, splits by hash."""
    i, a, b = F.col("task_id"), F.col("a"), F.col("b")
    rows = spark.range(n).select(F.col("id").alias("task_id")).withColumn("a", i % 97).withColumn("b", (i * 31) % 89)
    text = lambda c: c.cast("string")
    say = lambda form, *c: F.format_string(form, *c)
    big = a * b * b
    families = [
        ("add", say("What is %d plus %d?", a, b), text(a + b)), ("subtract", say("What is %d minus %d?", a, b), text(a - b)), ("multiply", say("What is %d times %d?", a, b), text(a * b)),
        ("mod10", say("What is the last digit of %d times %d?", a, b), text(a * b % 10)), ("larger", say("Which is larger, %d or %d?", a, b), text(F.greatest(a, b))), ("difference", say("How far apart are %d and %d?", a, b), text(F.abs(a - b))),
        ("upper", say("Write word%d in capitals.", a), say("WORD%d", a)), ("reverse", say("Write %d backwards.", a + 100), F.reverse(text(a + 100))), ("count", say("How many digits has %d?", big), text(F.length(text(big)))),
        ("last", say("Reply with the last word: %d then %d.", a, b), text(b)),
    ]
    made = F.array(*(F.struct(F.lit(name).alias("family"), prompt.alias("prompt"), answer.alias("answer")) for name, prompt, answer in families))
    split = F.when(X.hash_mod(X.hash_order("split", i), 100) < 5, "validation").otherwise("train")
    return rows.select("task_id", F.get(made, (i % len(families)).cast("int")).alias("t"), split.alias("split")).select("task_id", "t.family", "t.prompt", "t.answer", "split")


def tool_walks(tasks: DataFrame) -> DataFrame:
    """``(id, family, trace, calls, answer)`` of tasks ``(id, family, a, b, op)`` in the record environment.

    A walk looks up the root and then the leaf and hands both values to the
    operation. In family "redirect" the root names an alias first, which says where
    the leaf has moved; in "retry" the first look at the leaf fails for the time
    being; in "branch" the root offers two records and a route, the leaf being on it.
    """
    a, b = F.col("a"), F.col("b")
    step = lambda name, gives: F.concat(F.lit(name + ">"), gives.cast("string"))
    answer = F.when(F.col("op") == "add", a + b).otherwise(a - b)
    family = F.col("family")
    walk = F.array_compact(F.array(
        step("root", a), F.when(family == "redirect", step("alias", F.lit("moved"))), F.when(family == "retry", step("leaf", F.lit("temporary_error"))), step("leaf", b),
        F.concat("op", F.lit(">"), answer.cast("string")),
    ))
    return tasks.select("id", "family", F.array_join(walk, " ").alias("trace"), F.size(walk).alias("calls"), answer.alias("answer"))


def conversation_reward(final: Column, calls: Column, wanted: Column, most: float = 3.0) -> Column:
    """Without calls: half a point for a length from 5 to 800. With calls: half a point for as many calls as results (less for each too many or too few)
    and up to 2.5 for the results that the last answer says. Less the repetition penalty, within ``most`` either way."""
    n = F.size(wanted)
    said = F.size(F.filter(wanted, lambda x: F.contains(F.lower(final), F.lower(x))))
    gap = F.abs(calls - n)
    plain = F.when(F.length(F.trim(final)).between(5, 800), 0.5).otherwise(-0.5)
    tools = F.when(gap == 0, 0.5).otherwise(-0.5 * gap) + F.when(n > 0, said * 2.5 / F.greatest(n, F.lit(1))).otherwise(0.0)
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.when(calls == 0, plain).otherwise(tools) - X.repetition_penalty(final)))
