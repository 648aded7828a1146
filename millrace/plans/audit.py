"""Audits: provenance, totals, ledgers, capacity and stored-pair checks."""

from __future__ import annotations

import json
import os

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores, verify
from ..functions import text as X
from ..operators import budget, contamination, dedup
from ..runtime import table
from ..sources import files
from ..streaming import events as streams
from .registry import query


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN sha256(text)<>content_sha256 THEN 'hash' WHEN loss_target_tokens IS NULL OR loss_target_tokens<>nonpad_input_tokens-1 THEN 'loss' WHEN text_tokens IS NULL OR text_tokens<>nonpad_input_tokens-2 THEN 'text_tokens' WHEN padded_compute_tokens<>768 THEN 'padding' ELSE 'bound' END AS reason FROM pretrain_records) GROUP BY reason""")
def q1_provenance_binding(spark, d):
    loss, nonpad = F.col("loss_target_tokens"), F.col("nonpad_input_tokens")
    reason = F.when(F.sha2("text", 256) != F.col("content_sha256"), "hash").when(loss.isNull() | (loss != nonpad - 1), "loss").when(F.col("text_tokens").isNull() | (F.col("text_tokens") != nonpad - 2), "text_tokens").when(F.col("padded_compute_tokens") != 768, "padding").otherwise("bound")
    return table(spark, d, "pretrain_records").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s.source_id, s.revision = p.revision AS same_revision, s.repo_id = p.repo_id AS same_repo FROM sources s JOIN (SELECT lower(replace(trim(source),'-','_')) AS source_id, max(revision) AS revision, max(repo_id) AS repo_id FROM pretrain_records GROUP BY ALL) p USING (source_id)""")
def q3_evidence_chain(spark, d):
    seen = table(spark, d, "pretrain_records").groupBy(F.lower(F.replace(F.trim("source"), F.lit("-"), F.lit("_"))).alias("source_id")).agg(F.max("revision").alias("r"), F.max("repo_id").alias("p"))
    return table(spark, d, "sources").join(seen, "source_id").select("source_id", (F.col("revision") == F.col("r")).alias("same_revision"), (F.col("repo_id") == F.col("p")).alias("same_repo"))


@query("""SELECT source_id, revision, count(*) AS n_rows, count(*) FILTER (WHERE normalized_prompt IS NULL OR normalized_prompt='') AS empties, count(DISTINCT coalesce(config,'')) AS configs, count(*)>=50 AS enough FROM eval_reference GROUP BY ALL""")
def q5_pinned_benchmarks(spark, d):
    return table(spark, d, "eval_reference").groupBy("source_id", "revision").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("normalized_prompt").isNull() | (F.col("normalized_prompt") == "")).alias("empties"), F.countDistinct(F.coalesce("config", F.lit(""))).alias("configs"), (F.count(F.lit(1)) >= 50).alias("enough"))


@query("""SELECT DISTINCT sha256('blank|'||candidate_id) AS event_id, candidate_id, 'stale_size' AS reason FROM pretrain_records WHERE loss_target_tokens IS NULL OR loss_target_tokens < 1""")
def q6_exclusion_ledger(spark, d):
    rows = table(spark, d, "pretrain_records").filter("loss_target_tokens is null or loss_target_tokens < 1")
    return rows.select(X.hash_order("blank", F.col("candidate_id")).alias("event_id"), "candidate_id", F.lit("stale_size").alias("reason")).dropDuplicates(["event_id"])


@query("""SELECT fault, count(*) AS n FROM (SELECT candidate_id, 'duplicate_id' AS fault FROM candidates GROUP BY candidate_id HAVING count(*)>1 UNION ALL SELECT candidate_id, 'null_provenance' FROM candidates WHERE provenance_json IS NULL UNION ALL SELECT candidate_id, 'digest' FROM candidates WHERE prompt_digest IS NULL OR prompt_digest<>sha256(prompt_norm)
 UNION ALL SELECT candidate_id, 'exact_digest' FROM candidates WHERE exact_digest<>sha256(payload_json) UNION ALL SELECT candidate_id, 'too_long' FROM candidates WHERE valid_targets>rendered_tokens) GROUP BY fault""")
def q7_store_audit(spark, d):
    """All failures of a dataset as one union of small frames, counted."""
    c = table(spark, d, "candidates")
    frames = {
        "null_provenance": F.col("provenance_json").isNull(),
        "digest": F.col("prompt_digest").isNull() | (F.col("prompt_digest") != F.sha2("prompt_norm", 256)),
        "exact_digest": F.col("exact_digest") != F.sha2("payload_json", 256),
        "too_long": F.col("valid_targets") > F.col("rendered_tokens"),
    }
    flags = c.select(F.explode(F.filter(F.array(*(F.when(v, k) for k, v in frames.items())), lambda x: x.isNotNull())).alias("fault"))
    double = c.groupBy("candidate_id").count().filter("count > 1").select(F.lit("duplicate_id").alias("fault"))
    return flags.unionByName(double).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'candidate' AS what, count(*) AS repeated FROM (SELECT candidate_id FROM pretrain_records GROUP BY 1 HAVING count(*)>1) UNION ALL SELECT 'location', count(*) FROM (SELECT shard, line_number FROM pretrain_records GROUP BY ALL HAVING count(*)>1) UNION ALL SELECT 'revision', count(*) FROM pretrain_records WHERE length(revision)<>40""")
def q8_sidecar_integrity(spark, d):
    p = table(spark, d, "pretrain_records")
    several = lambda what, *keys: p.groupBy(*keys).count().filter("count > 1").agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("repeated"))
    return several("candidate", "candidate_id").unionByName(several("location", "shard", "line_number")).unionByName(p.filter(F.length("revision") != 40).agg(F.lit("revision").alias("what"), F.count(F.lit(1)).alias("repeated")))


_N1 = "lower(regexp_replace({c},'[^\\p{{L}}\\p{{N}}]','','g'))"


@query(f"""WITH h AS (SELECT DISTINCT d.doc_id, e.item_id, e.source_id FROM (SELECT doc_id, {_N1.format(c='text')} AS n FROM documents) d JOIN (SELECT item_id, source_id, {_N1.format(c='normalized_prompt')} AS p FROM eval_reference) e ON contains(d.n,e.p) AND d.n<>e.p AND length(e.p)>=20)
 SELECT source_id, doc_id, item_id, n FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY doc_id, item_id) AS k, count(*) OVER (PARTITION BY source_id) AS n FROM h) WHERE k<=5""")
def q9_contamination_report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.alnum_lower(F.col("text")).alias("norm"))
    items = table(spark, d, "eval_reference").select("item_id", "source_id", X.alnum_lower(F.col("normalized_prompt")).alias("p"))
    hits = contamination.contained(docs, "doc_id", "norm", items, "item_id", "p").select(F.col("text_id").alias("doc_id"), F.col("pattern_id").alias("item_id")).join(items.select("item_id", "source_id"), "item_id")
    counts = hits.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    first = hits.withColumn("k", F.row_number().over(W.partitionBy("source_id").orderBy("doc_id", "item_id"))).filter("k <= 5")
    return first.join(counts, "source_id").select("source_id", "doc_id", "item_id", "n")


@query("""WITH c AS (SELECT DISTINCT candidate_id, bucket, origin_group_id, exact_digest, valid_targets, selection_rank FROM candidates), o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY origin_group_id ORDER BY selection_rank, candidate_id)=1), e AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY exact_digest ORDER BY selection_rank, candidate_id)=1)
 SELECT 'gross' AS layer, bucket, count(*) AS n, sum(valid_targets)::BIGINT AS targets FROM c GROUP BY bucket UNION ALL SELECT 'origin', bucket, count(*), sum(valid_targets)::BIGINT FROM o GROUP BY bucket UNION ALL SELECT 'exact', bucket, count(*), sum(valid_targets)::BIGINT FROM e GROUP BY bucket""")
def q11_capacity_layers(spark, d):
    c = table(spark, d, "candidates").select("candidate_id", "bucket", "origin_group_id", "exact_digest", "valid_targets", "selection_rank").distinct()
    o = dedup.first_per_key(c, ["origin_group_id"], F.col("selection_rank"), F.col("candidate_id"))
    e = dedup.first_per_key(o, ["exact_digest"], F.col("selection_rank"), F.col("candidate_id"))
    layer = lambda name, df: df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("valid_targets").alias("targets")).select(F.lit(name).alias("layer"), "bucket", "n", "targets")
    return layer("gross", c).unionByName(layer("origin", o)).unionByName(layer("exact", e))


@query("""SELECT bucket, count(*) AS taken, sum(n)::BIGINT AS targets FROM (SELECT *, sum(n) OVER (PARTITION BY bucket ORDER BY h) - n AS before FROM (SELECT DISTINCT candidate_id, bucket, valid_targets AS n, sha256('top|'||candidate_id) AS h FROM candidates WHERE lower(trim(split))='train' AND candidate_id NOT IN (SELECT candidate_id FROM candidates WHERE substr(sha256('7|'||candidate_id),1,1)='0'))) WHERE before < 2000 GROUP BY bucket""")
def o20_top_up(spark, d):
    """What is still missing is filled from candidates by rank, without those taken before."""
    c = table(spark, d, "candidates").select("candidate_id", "bucket", F.col("valid_targets").alias("n"), F.lower(F.trim("split")).alias("s")).distinct()
    taken = c.filter(F.substring(X.hash_order("7", F.col("candidate_id")), 1, 1) == "0").select("candidate_id")
    rows = c.filter("s = 'train'").join(taken, "candidate_id", "left_anti").withColumn("h", X.hash_order("top", F.col("candidate_id")))
    return budget.take_budget(rows, "n", 2000, ["bucket"], F.col("h")).groupBy("bucket").agg(F.count(F.lit(1)).alias("taken"), F.sum("n").alias("targets"))


@query("""WITH a AS (SELECT user_id AS k, avg(value) AS x FROM events WHERE event_type='click' GROUP BY 1), b AS (SELECT user_id AS k, avg(value) AS y FROM events WHERE event_type='view' GROUP BY 1) SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS paired, count(*) FILTER (WHERE x IS NULL) AS only_b, count(*) FILTER (WHERE y IS NULL) AS only_a FROM a FULL JOIN b USING (k)""")
def j12_paired_alignment(spark, d):
    side = lambda kind, out: table(spark, d, "events").filter(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias(out))
    x, y = F.col("x"), F.col("y")
    return side("click", "x").join(side("view", "y"), "user_id", "full").agg(F.count_if(x.isNotNull() & y.isNotNull()).alias("paired"), F.count_if(x.isNull()).alias("only_b"), F.count_if(y.isNull()).alias("only_a"))


@query("""SELECT date_trunc('hour', ts)::VARCHAR AS hour_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL""")
def st1_hourly_counts(spark, d):
    """The batch form of the streamed windows."""
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("string").alias("hour_start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query()
def st2_streamed_first_seen(spark, d):
    return streams.run_once(streams.first_seen(_stream(spark, f"{d}/events.parquet"), "event_id"))


def _stream(spark, path: str):
    """A parquet table as a stream, be it one file or a folder."""
    folder, name = (path, "*.parquet") if os.path.isdir(path) else os.path.split(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)


@query()
def s1_located_scan(spark, d):
    rows = files.with_location(files.read_corpus(spark, f"{d}/pretrain_records.parquet", "parquet").select("candidate_id", "_metadata"))
    return rows.select("candidate_id", "row_index")


@query("""SELECT s.source_id, coalesce(regexp_matches(s.revision,'^[0-9a-f]{40}$'),false) AS pinned, s.license IS NOT NULL AS licensed, coalesce(regexp_matches(s.revision,'^[0-9a-f]{40}$'),false) AND s.license IS NOT NULL AS ready FROM sources s""")
def s21_source_resolution(spark, d):
    pinned, licensed = F.coalesce(F.col("revision").rlike("^[0-9a-f]{40}$"), F.lit(False)), F.col("license").isNotNull()
    return table(spark, d, "sources").select("source_id", pinned.alias("pinned"), licensed.alias("licensed"), (pinned & licensed).alias("ready"))


@query()
def t32_arithmetic(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.lit("* 3 + 2 ^ 2")).alias("e"))
    return rows.select("o_orderkey", verify.vectorised(verify.arithmetic, T.DoubleType(), "e").alias("value"))


@query()
def d4_greedy_near_dedup(spark, d):
    """Prompts kept greedily in hash order: one goes if a kept one is near. Only prompts of 50 characters or more can be near; a missing prompt equals no other."""
    rows = table(spark, d, "candidates").select("candidate_id", "prompt_norm")
    edges = contamination.gram_pairs(rows.filter(F.length("prompt_norm") >= 50), "candidate_id", "prompt_norm", 5, 0.85)
    once = rows.filter("prompt_norm is not null").groupBy("prompt_norm").agg(F.min("candidate_id").alias("id")).select("id")
    once = once.unionByName(rows.filter("prompt_norm is null").select(F.col("candidate_id").alias("id")).distinct())
    return dedup.greedy(once, edges, lambda c: F.sha2(c, 256))


_GRAMS = "list_distinct(list_transform(range(1, length(t)-3), lambda i: substr(t,i,5)))"


@query(f"""WITH t AS (SELECT min(candidate_id) AS id, prompt_norm AS t FROM candidates WHERE prompt_norm IS NOT NULL GROUP BY prompt_norm), g AS (SELECT id, {_GRAMS} AS g FROM t), u AS (SELECT id, len(g) AS n, unnest(g) AS x FROM g)
 SELECT a.id AS id_a, b.id AS id_b, count(*)::DOUBLE/(a.n+b.n-count(*)) AS jaccard FROM u a JOIN u b ON a.x=b.x AND a.id<b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.85*(a.n+b.n-count(*))""")
def d5_near_audit(spark, d):
    """All pairs of different prompts with a Jaccard of at least 0.85, by the exact join: SimHash bands of 16 bits find only about 7 in 10 of them."""
    return contamination.gram_pairs(table(spark, d, "candidates"), "candidate_id", "prompt_norm", 5, 0.85)


@query("""WITH r AS (SELECT task, length(normalized_prompt) AS v, row_number() OVER (PARTITION BY task ORDER BY item_id)-1 AS k FROM eval_reference), n AS (SELECT task, count(*) AS n FROM r GROUP BY task),
 s AS (SELECT task, g.range AS rep, n, unnest(list_transform(range(0,n), lambda i: (('0x'||substr(sha256(task||'|'||g.range||'|'||(i//8)),1+8*(i%8)::INT,8))::BIGINT % n))) AS draw FROM n CROSS JOIN range(0,10000) g), m AS (SELECT s.task, s.rep, sum(r.v)/any_value(s.n) AS mean FROM s JOIN r ON r.task=s.task AND r.k=s.draw GROUP BY s.task, s.rep),
 a AS (SELECT rep, avg(mean) AS macro FROM m GROUP BY rep) SELECT quantile_cont(macro,0.025) AS low, quantile_cont(macro,0.975) AS high FROM a""")
def a19_stratified_bootstrap(spark, d):
    """10,000 resamples of each task by hash; tasks weigh alike."""
    rows = table(spark, d, "eval_reference").select("task", "item_id", F.length("normalized_prompt").alias("v"))
    macro = scores.bootstrap_means(rows, ["task"], "v", F.col("item_id"), 10_000).groupBy("rep").agg(F.avg("mean").alias("macro"))
    return macro.agg(F.expr("percentile(macro, 0.025)").alias("low"), F.expr("percentile(macro, 0.975)").alias("high"))


@query("""WITH p AS (SELECT a.item_id, string_split(a.normalized_prompt,' ') AS x, string_split(b.normalized_prompt,' ') AS y FROM eval_reference a JOIN eval_reference b ON b.item_id=a.item_id+3), c AS (SELECT *, (SELECT count(*) FROM (SELECT unnest(range(1, least(len(x),len(y))+1)) AS i) WHERE x[1:i]=y[1:i]) AS common FROM p)
 SELECT item_id, common::BIGINT AS common, CASE WHEN common=len(x) OR common=len(y) THEN 'zero_targets' WHEN len(x)>60 OR len(y)>60 THEN 'too_long' ELSE 'kept' END AS reason FROM c""")
def c8_preference_encode(spark, d):
    """Common prefix of the two sides in whitespace tokens, and why a pair is rejected."""
    e = table(spark, d, "eval_reference").select("item_id", F.split("normalized_prompt", " ").alias("x"))
    p = e.join(e.select((F.col("item_id") - 3).alias("item_id"), F.col("x").alias("y")), "item_id")
    n = F.least(F.size("x"), F.size("y"))
    common = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.slice("x", F.lit(1), i) == F.slice("y", F.lit(1), i))).cast("long")
    rows = p.withColumn("common", common)
    reason = F.when((F.col("common") == F.size("x")) | (F.col("common") == F.size("y")), "zero_targets").when((F.size("x") > 60) | (F.size("y") > 60), "too_long").otherwise("kept")
    return rows.select("item_id", "common", reason.alias("reason"))


@query("""SELECT count(*) AS n_rows, sum(CASE WHEN line_number % 64 = 0 THEN 1 ELSE 0 END)::BIGINT AS batch_ends, count(*) FILTER (WHERE source_id IS NULL) AS no_source FROM raw_pairs WHERE line_number > 2*64""")
def o23_resume_sampler(spark, d):
    return table(spark, d, "raw_pairs").filter(F.col("line_number") > 128).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("line_number") % 64 == 0, 1).otherwise(0)).alias("batch_ends"), F.count_if(F.col("source_id").isNull()).alias("no_source"))
