"""Evaluation arithmetic: weighted means, rates, percentiles, paired tests, rewards and gates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import scores
from ..operators import budget
from ..operators.quantiles import exact_quantiles, joined
from ..runtime import table
from .registry import query


def _events(spark, d):
    return table(spark, d, "events")


@query("""SELECT shard, source, sum(nonpad_input_tokens)::BIGINT AS nonpad, sum(padded_compute_tokens)::BIGINT AS padded, sum(coalesce(loss_target_tokens,0))::BIGINT AS loss, count(*) AS n_rows, grouping(source)::BIGINT AS is_total FROM pretrain_records GROUP BY GROUPING SETS ((shard, source), (shard))""")
def a1_token_totals(spark, d):
    sums = table(spark, d, "pretrain_records").groupingSets([["shard", "source"], ["shard"]], "shard", "source")
    return sums.agg(F.sum("nonpad_input_tokens").alias("nonpad"), F.sum("padded_compute_tokens").alias("padded"), F.sum(F.coalesce("loss_target_tokens", F.lit(0))).alias("loss"), F.count(F.lit(1)).alias("n_rows"), F.grouping("source").cast("long").alias("is_total"))


@query("""SELECT bucket, split_part(origin_group_id,':',1) AS source, count(*) AS n, coalesce(sum(valid_targets),0)::BIGINT AS targets FROM candidates GROUP BY ROLLUP (bucket, source)""")
def a2_rollup(spark, d):
    rows = table(spark, d, "candidates").select("bucket", F.split_part("origin_group_id", F.lit(":"), F.lit(1)).alias("source"), "valid_targets")
    return rows.rollup("bucket", "source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("valid_targets"), F.lit(0)).alias("targets"))


@query("SELECT prompt_norm, count(DISTINCT bucket) AS buckets FROM candidates GROUP BY prompt_norm HAVING count(DISTINCT candidate_id) > 1")
def a3_having_distinct(spark, d):
    got = table(spark, d, "candidates").groupBy(X.key128(F.col("prompt_norm"))).agg(F.first("prompt_norm").alias("prompt_norm"), F.size(F.collect_set("bucket")).cast("long").alias("buckets"), F.min("candidate_id").alias("a"), F.max("candidate_id").alias("b"))
    return got.filter("a <> b").select("prompt_norm", "buckets")


@query("""SELECT event_type, sum(value*user_id)/sum(user_id) AS nll, CASE WHEN sum(value*user_id)/sum(user_id) < 700 THEN exp(sum(value*user_id)/sum(user_id)) END AS perplexity FROM events WHERE user_id>0 AND value IS NOT NULL GROUP BY event_type""")
def a4_weighted_nll(spark, d):
    got = _events(spark, d).filter("user_id > 0 and value is not null").groupBy("event_type").agg((F.sum(F.col("value") * F.col("user_id")) / F.sum("user_id")).alias("nll"))
    return got.withColumn("perplexity", F.when(F.col("nll") < 700, F.exp("nll")))


@query("""SELECT event_type, avg((value>1)::INT) AS rate, count(*) FILTER (WHERE value>1) AS hits, max(value) AS peak FROM events GROUP BY event_type""")
def a5_grouped_rate(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.avg((F.col("value") > 1).cast("int")).alias("rate"), F.count_if(F.col("value") > 1).alias("hits"), F.max("value").alias("peak"))


@query("""WITH g AS (SELECT user_id, event_id%50 AS task, bool_or(value>2) AS any_ok, bool_and(value>2) AS all_ok FROM events GROUP BY ALL) SELECT avg(any_ok::INT) AS pass_at_k, avg((NOT any_ok)::INT) AS all_zero, avg(all_ok::INT) AS all_one, avg((any_ok AND NOT all_ok)::INT) AS mixed FROM g""")
def a6_pass_at_k(spark, d):
    g = _events(spark, d).groupBy("user_id", (F.col("event_id") % 50).alias("task")).agg(F.bool_or(F.col("value") > 2).alias("a"), F.bool_and(F.col("value") > 2).alias("b"))
    rate = lambda c: F.avg(c.cast("int"))
    return g.agg(rate(F.col("a")).alias("pass_at_k"), rate(~F.col("a")).alias("all_zero"), rate(F.col("b")).alias("all_one"), rate(F.col("a") & ~F.col("b")).alias("mixed"))


@query("SELECT task, source_id, count(*) AS n FROM eval_reference GROUP BY ALL")
def a7_category_counts(spark, d):
    return table(spark, d, "eval_reference").groupBy("task", "source_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT t.task, s.split, coalesce(c.n,0) AS n FROM (SELECT DISTINCT task FROM eval_reference) t CROSS JOIN (SELECT DISTINCT split FROM eval_reference) s LEFT JOIN (SELECT task, split, count(*) AS n FROM eval_reference GROUP BY ALL) c ON c.task=t.task AND c.split=s.split)
 SELECT max(n)-min(n) AS spread, min(n)>0 AS full_support FROM g""")
def a8_joint_balance(spark, d):
    e = table(spark, d, "eval_reference")
    grid = e.select("task").distinct().crossJoin(e.select("split").distinct())
    n = grid.join(e.groupBy("task", "split").agg(F.count(F.lit(1)).alias("n")), ["task", "split"], "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg((F.max("n") - F.min("n")).alias("spread"), (F.min("n") > 0).alias("full_support"))


_S = "list_sort(list(value))"


@query(f"""SELECT event_type, quantile_disc(value, 0.5) AS nearest50, quantile_disc(value, 0.95) AS nearest95, {_S}[(round_even((count(value)-1)*0.9,0))::INT+1] AS rounded90, {_S}[floor(0.9*count(value))::INT+1] AS floor90, quantile_cont(value, 0.9) AS linear90 FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def a9_percentiles(spark, d):
    """Four definitions of a percentile that must not be exchanged; places are looked up by rank, so no group is gathered or sorted in one task."""
    wanted = {"nearest50": ("disc", 0.5), "nearest95": ("disc", 0.95), "rounded90": ("rounded", 0.9), "floor90": ("floor", 0.9), "linear90": ("cont", 0.9)}
    return exact_quantiles(_events(spark, d), ["event_type"], "value", wanted)


@query("""SELECT source, avg(length(text)) AS mean_len, quantile_disc(length(text),0.5)::BIGINT AS p50, quantile_disc(length(text),0.99)::BIGINT AS p99, max(length(text))::BIGINT AS longest, count(*) FILTER (WHERE length(text)>3000) AS truncated, avg((length(text)>3000)::INT) AS truncated_ratio, avg(greatest(0, 3000-length(text))) AS mean_padding FROM documents WHERE text IS NOT NULL GROUP BY source""")
def a13_length_summary(spark, d):
    rows = table(spark, d, "documents").filter("text is not null").select(F.coalesce("source", F.lit("")).alias("s"), "source", F.length("text").cast("long").alias("n"))
    n = F.col("n")
    sums = rows.groupBy("s").agg(
        F.first("source").alias("source"), F.avg(n).alias("mean_len"), F.max(n).alias("longest"), F.count_if(n > 3000).alias("truncated"), F.avg((n > 3000).cast("int")).alias("truncated_ratio"), F.avg(F.greatest(F.lit(0), 3000 - n)).alias("mean_padding")
    )
    return sums.join(exact_quantiles(rows, ["s"], "n", {"p50": ("disc", 0.5), "p99": ("disc", 0.99)}), "s").drop("s")


@query("""SELECT w AS token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>'')) AS w FROM documents) GROUP BY w""")
def a15_token_frequency(spark, d):
    return table(spark, d, "documents").select(F.explode(X.words(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT source, sum(length(text))::DOUBLE/sum(nonpad_input_tokens) AS chars_per_token, sum(strlen(text))::DOUBLE/sum(nonpad_input_tokens) AS bytes_per_token FROM pretrain_records GROUP BY source""")
def a16_compression_ratio(spark, d):
    n = F.sum("nonpad_input_tokens")
    return table(spark, d, "pretrain_records").groupBy("source").agg((F.sum(F.length("text")) / n).alias("chars_per_token"), (F.sum(F.octet_length("text")) / n).alias("bytes_per_token"))


_PAIR = "(SELECT user_id AS task, avg(value) FILTER (WHERE event_id%2=0) AS a, avg(value) FILTER (WHERE event_id%2=1) AS b FROM events GROUP BY user_id)"


def _paired(spark, d):
    even = F.col("event_id") % 2 == 0
    return _events(spark, d).groupBy(F.col("user_id").alias("task")).agg(F.avg(F.when(even, F.col("value"))).alias("a"), F.avg(F.when(~even, F.col("value"))).alias("b"))


@query(f"""SELECT count(*) FILTER (WHERE b>a+0.05) AS improved, count(*) FILTER (WHERE abs(b-a)<=0.05) AS tied, count(*) FILTER (WHERE b<a-0.05) AS regressed, corr(a,b) AS pearson, avg(CASE WHEN abs(a-b)<=1e-7 THEN 0.5 WHEN b>a THEN 1 ELSE 0 END) AS credit,
 count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS unpaired FROM {_PAIR}""")
def a17_paired_differences(spark, d):
    a, b = F.col("a"), F.col("b")
    return _paired(spark, d).agg(
        F.count_if(b > a + 0.05).alias("improved"), F.count_if(F.abs(b - a) <= 0.05).alias("tied"), F.count_if(b < a - 0.05).alias("regressed"), F.corr("a", "b").alias("pearson"), F.avg(F.when(F.abs(a - b) <= 1e-7, 0.5).when(b > a, 1.0).otherwise(0.0)).alias("credit"), F.count_if(a.isNull() | b.isNull()).alias("unpaired")
    )


@query(f"""WITH p AS (SELECT row_number() OVER (ORDER BY task)-1 AS k, b-a AS diff, count(*) OVER () AS n FROM {_PAIR} WHERE a IS NOT NULL AND b IS NOT NULL), s AS (SELECT rep, n, unnest(list_transform(range(0,n), lambda i: (('0x'||substr(sha256(rep||'|'||(i//8)),1+8*(i%8)::INT,8))::BIGINT % n))) AS draw FROM (SELECT g.range AS rep, (SELECT count(*) FROM p) AS n FROM range(0,10000) g)),
 m AS (SELECT rep, sum(diff)/any_value(s.n) AS mean FROM s JOIN p ON p.k=s.draw GROUP BY rep) SELECT (SELECT avg(diff) FROM p) AS mean_diff, quantile_cont(mean,0.025) AS low, quantile_cont(mean,0.975) AS high FROM m""")
def a18_paired_bootstrap(spark, d):
    """10,000 resamples by hash, so it is deterministic and distributed."""
    rows = _paired(spark, d).dropna().withColumn("diff", F.col("b") - F.col("a"))
    means = scores.bootstrap_means(rows, [], "diff", F.col("task"), 10_000)
    ends = means.agg(F.expr("percentile(mean, 0.025)").alias("low"), F.expr("percentile(mean, 0.975)").alias("high"))
    return rows.agg(F.avg("diff").alias("mean_diff")).crossJoin(ends)


@query("""SELECT event_type, n, n::DOUBLE/sum(n) OVER () AS share, n::DOUBLE/sum(n) OVER () > 0.5 AS collapsed FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""")
def a24_collapse(spark, d):
    got = _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())
    return got.select("event_type", "n", share.alias("share"), (share > 0.5).alias("collapsed"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS z, count(*) OVER (PARTITION BY user_id) AS n FROM events)
 SELECT user_id, avg(value) FILTER (WHERE k<=n//2) AS first_half, avg(value) FILTER (WHERE k>n//2) AS second_half, avg(value) FILTER (WHERE z<=10) AS trailing10, avg(value) AS mean, stddev_samp(value) AS spread FROM r GROUP BY user_id""")
def a25_trends(spark, d):
    w = W.partitionBy("user_id")
    rows = _events(spark, d).select("user_id", "value", F.row_number().over(w.orderBy("event_id")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    half, k = F.expr("n div 2"), F.col("k")
    return rows.groupBy("user_id").agg(F.avg(F.when(k <= half, F.col("value"))).alias("first_half"), F.avg(F.when(k > half, F.col("value"))).alias("second_half"), F.avg(F.when(k > F.col("n") - 10, F.col("value"))).alias("trailing10"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"))


@query("""SELECT event_id, (value - avg(value) OVER (PARTITION BY user_id)) / (stddev_pop(value) OVER (PARTITION BY user_id) + 1e-4) AS advantage FROM events WHERE value IS NOT NULL""")
def a28_group_advantage(spark, d):
    rows = _events(spark, d).filter("value is not null").select("event_id", "user_id", "value")
    g = rows.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return rows.join(g, "user_id").select("event_id", ((F.col("value") - F.col("m")) / (F.col("s") + 1e-4)).alias("advantage"))


@query("""SELECT CASE WHEN text IS NULL THEN 'null' WHEN length(text)<50 THEN 'short' WHEN lang IS NULL THEN 'no_lang' ELSE 'kept' END AS reason, lower(lang) AS lang_name, count(*) AS n FROM documents GROUP BY GROUPING SETS ((reason), (lang_name), (reason, lang_name))""")
def a29_reason_tally(spark, d):
    reason = F.when(F.col("text").isNull(), "null").when(F.length("text") < 50, "short").when(F.col("lang").isNull(), "no_lang").otherwise("kept")
    rows = table(spark, d, "documents").select(reason.alias("reason"), F.lower("lang").alias("lang_name"))
    return rows.groupingSets([["reason"], ["lang_name"], ["reason", "lang_name"]], "reason", "lang_name").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE text IS NULL) AS null_texts, count(*)-count(DISTINCT content_sha256) AS duplicate_digests, count(*) FILTER (WHERE loss_target_tokens IS NULL OR loss_target_tokens<1) AS bad_sizes FROM pretrain_records),
 g AS (SELECT 'null_texts' AS gate, null_texts AS observed, 0 AS at_most FROM c UNION ALL SELECT 'duplicate_digests', duplicate_digests, 100 FROM c UNION ALL SELECT 'bad_sizes', bad_sizes, 5 FROM c) SELECT gate, observed::BIGINT AS observed, at_most::INT AS at_most, observed<=at_most AS passed FROM g""")
def a30_quality_gates(spark, d):
    c = table(spark, d, "pretrain_records").agg(F.count_if(F.col("text").isNull()).alias("null_texts"), (F.count(F.lit(1)) - F.countDistinct("content_sha256")).alias("duplicate_digests"), F.count_if(F.col("loss_target_tokens").isNull() | (F.col("loss_target_tokens") < 1)).alias("bad_sizes"))
    gates = c.selectExpr("stack(3, 'null_texts', null_texts, 0, 'duplicate_digests', duplicate_digests, 100, 'bad_sizes', bad_sizes, 5) as (gate, observed, at_most)")
    return gates.withColumn("passed", F.col("observed") <= F.col("at_most"))


@query("""SELECT sha256(string_agg(line, ',' ORDER BY line)) AS fingerprint FROM (SELECT shard||':'||count(*)||':'||sum(nonpad_input_tokens)::BIGINT AS line FROM pretrain_records GROUP BY shard)""")
def a31_fingerprint(spark, d):
    lines = table(spark, d, "pretrain_records").groupBy("shard").agg(F.concat_ws(":", F.col("shard"), F.count(F.lit(1)).cast("string"), F.sum("nonpad_input_tokens").cast("string")).alias("line"))
    return lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ","), 256).alias("fingerprint"))


@query("""(SELECT unit_id, max_repeats, 'only_a' AS side FROM (SELECT unit_id, max_repeats FROM mix_targets WHERE mix_id='pretrain_a' EXCEPT SELECT unit_id, max_repeats FROM mix_targets WHERE mix_id='pretrain_b')) UNION ALL
 (SELECT unit_id, max_repeats, 'only_b' FROM (SELECT unit_id, max_repeats FROM mix_targets WHERE mix_id='pretrain_b' EXCEPT SELECT unit_id, max_repeats FROM mix_targets WHERE mix_id='pretrain_a'))""")
def a32_config_parity(spark, d):
    a, b = (table(spark, d, "mix_targets").filter(F.col("mix_id") == m).select("unit_id", "max_repeats") for m in ("pretrain_a", "pretrain_b"))
    return a.subtract(b).withColumn("side", F.lit("only_a")).unionByName(b.subtract(a).withColumn("side", F.lit("only_b")))


@query("""SELECT event_type, median(value) AS mid, quantile_disc(value,0.95) AS p95, min(value) AS low, max(value) AS high, avg(value) FILTER (WHERE value>0) AS active_mean, median(value) FILTER (WHERE value>0) AS active_median FROM events GROUP BY event_type""")
def a33_latency_summary(spark, d):
    rows = _events(spark, d).select("event_type", "value")
    on = F.when(F.col("value") > 0, F.col("value"))
    sums = rows.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg(on).alias("active_mean"))
    every = exact_quantiles(rows, ["event_type"], "value", {"mid": ("cont", 0.5), "p95": ("disc", 0.95)})
    return joined([sums, every, exact_quantiles(rows.filter("value > 0"), ["event_type"], "value", {"active_median": ("cont", 0.5)})], ["event_type"])


@query("""SELECT source, count(*) FILTER (WHERE trim(coalesce(text,''))<>'') AS filled, count(*) FILTER (WHERE trim(coalesce(text,''))='') AS blank, avg(length(text)) AS mean_chars, median(length(text)) AS median_chars, count(*) FILTER (WHERE length(text)>=5000) AS cap_hits, count(DISTINCT text) AS unique_texts FROM documents GROUP BY source""")
def a37_continuations(spark, d):
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(filled).alias("filled"), F.count_if(~filled).alias("blank"), F.avg(F.length("text")).alias("mean_chars"), F.median(F.length("text")).alias("median_chars"), F.count_if(F.length("text") >= 5000).alias("cap_hits"), F.countDistinct("text").alias("unique_texts"))


@query(f"""SELECT avg(ln(1+exp(-0.1*(a-b)))) AS loss, avg((a>b)::INT) AS accuracy FROM {_PAIR} WHERE a IS NOT NULL AND b IS NOT NULL""")
def a41_preference_loss(spark, d):
    """Negative log sigmoid of the scaled margin."""
    margin = F.col("a") - F.col("b")
    return _paired(spark, d).dropna().agg(F.avg(F.log1p(F.exp(-0.1 * margin))).alias("loss"), F.avg((margin > 0).cast("int")).alias("accuracy"))


@query("""WITH p AS (SELECT l.l_orderkey, l.l_quantity, l.l_extendedprice FROM lineitem l) SELECT l_orderkey % 3 AS stratum, count(*) FILTER (WHERE l_quantity>30) AS wins, count(*) FILTER (WHERE l_quantity=30) AS ties, count(*) FILTER (WHERE l_quantity<30) AS losses, count(*) FILTER (WHERE l_quantity IS NULL) AS invalid, avg(CASE WHEN l_quantity>30 THEN 1 WHEN l_quantity=30 THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM p GROUP BY stratum""")
def a22_win_tally(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 3).alias("stratum")).agg(F.count_if(q > 30).alias("wins"), F.count_if(q == 30).alias("ties"), F.count_if(q < 30).alias("losses"), F.count_if(q.isNull()).alias("invalid"), F.avg(F.when(q > 30, 1.0).when(q == 30, 0.5).otherwise(0.0)).alias("score"))


@query("""SELECT label, count(*) AS n, avg(embedding[1])::DOUBLE AS mean_first, avg(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE)))::DOUBLE AS mean_square FROM embeddings GROUP BY label""")
def a15_embedding_stats(spark, d):
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.element_at("embedding", 1)).alias("mean_first"), F.avg(square).alias("mean_square"))
