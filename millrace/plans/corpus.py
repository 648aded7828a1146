"""Corpus building: de-duplication, contamination, budgets, splits and joins over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.unicode import spaced
from ..operators import budget, contamination, dedup
from ..runtime import table, written
from .registry import query

_N1 = "lower(regexp_replace({c},'[^\\p{{L}}\\p{{N}}]','','g'))"
_W = "list_filter(regexp_split_to_array(text,'\\s+'), lambda w: w <> '')"


def _clean(spark, d):
    """Documents that are the first of their normal form and neither equal to nor around a test item; normal forms are never shuffled, only their digests."""
    t = F.col("text")
    docs = table(spark, d, "documents").filter(t.rlike(r"\S"))
    rows = docs.select("doc_id", "source", X.word_count(t).cast("long").alias("n"), X.hash_order("42", F.col("doc_id")).alias("h"), F.sha2(X.alnum_lower(t), 256).alias("digest"))
    once = dedup.first_per_key(rows, ["digest"], F.col("h"))
    items = table(spark, d, "eval_reference").select("item_id", X.alnum_lower(F.col("normalized_prompt")).alias("p"))
    hits = contamination.contained(docs.select("doc_id", X.alnum_lower(t).alias("norm")), "doc_id", "norm", items, "item_id", "p")
    clean = once.join(items.select(F.sha2("p", 256).alias("digest")), "digest", "left_anti")
    return clean.join(hits.select(F.col("text_id").alias("doc_id")).distinct(), "doc_id", "left_anti")


_CLEAN = f"""r AS (SELECT doc_id, source, {_N1.format(c='text')} AS norm, len({_W})::BIGINT AS n, sha256('42|'||doc_id::VARCHAR) AS h FROM documents WHERE regexp_matches(text,'\\S')),
 o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY h) AS k FROM r) WHERE k=1), e AS (SELECT {_N1.format(c='normalized_prompt')} AS p FROM eval_reference),
 c AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM e WHERE o.norm=e.p OR (length(e.p)>=20 AND contains(o.norm,e.p))))"""


@query(f"""WITH {_CLEAN}, s AS (SELECT *, CASE WHEN ('0x'||substr(h,1,8))::BIGINT%100<2 THEN 'validation' WHEN ('0x'||substr(h,1,8))::BIGINT%100<4 THEN 'test' ELSE 'train' END AS split, n+1 AS loss FROM c),
 b AS (SELECT *, sum(loss) OVER (PARTITION BY source, split ORDER BY h) - loss AS before FROM s) SELECT source, split, count(*) AS n_rows, sum(loss)::BIGINT AS loss_tokens FROM b WHERE before < 2000 GROUP BY source, split""")
def flagship(spark, d):
    """The budgeted, de-duplicated, benchmark-clean mix per source and split."""
    rows = _clean(spark, d).withColumn("split", budget.hash_split(X.hash_mod(F.col("h"), 100), [("validation", 2), ("test", 4)], "train")).withColumn("loss", F.col("n") + 1)
    kept = budget.take_budget(rows, "loss", 2000, ["source", "split"], F.col("h"))
    return kept.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("loss").alias("loss_tokens"))


@query("""SELECT candidate_id, content_sha256, split FROM (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY CASE split WHEN 'train' THEN 0 ELSE 1 END, sample_key, candidate_id) AS k FROM pretrain_records) WHERE k=1""")
def d1_exact_first_wins(spark, d):
    rows = table(spark, d, "pretrain_records").select("candidate_id", "content_sha256", "split", "sample_key")
    return dedup.first_per_key(rows, ["content_sha256"], F.when(F.col("split") == "train", 0).otherwise(1), F.col("sample_key"), F.col("candidate_id")).select("candidate_id", "content_sha256", "split")


@query("""SELECT content_sha256 AS digest, nonpad_input_tokens AS token_count, count(*) AS occurrences, min(shard||'|'||lpad(line_number::VARCHAR,12,'0')) AS first_place FROM pretrain_records GROUP BY ALL""")
def d2_registry(spark, d):
    got = dedup.registry(table(spark, d, "pretrain_records"), "content_sha256", "nonpad_input_tokens", "shard", "line_number")
    return got.select("digest", "token_count", "occurrences", F.concat_ws("|", "first_shard", F.lpad(F.col("first_line").cast("string"), 12, "0")).alias("first_place"))


@query("""SELECT candidate_id FROM (SELECT candidate_id, row_number() OVER (PARTITION BY prompt_norm ORDER BY selection_rank, candidate_id) AS k FROM (SELECT DISTINCT candidate_id, prompt_norm, selection_rank FROM candidates)) WHERE k=1""")
def d3_prompt_first_wins(spark, d):
    rows = table(spark, d, "candidates").select("candidate_id", X.key128(F.col("prompt_norm")).alias("prompt"), "selection_rank")
    return dedup.first_per_key(rows, ["prompt"], F.col("selection_rank"), F.col("candidate_id")).select("candidate_id")


@query("""SELECT origin_group_id, arg_min(bucket, selection_rank) AS bucket, min(selection_rank) AS selection_rank FROM candidates GROUP BY origin_group_id""")
def d6_origin_claims(spark, d):
    return dedup.origin_claims(table(spark, d, "candidates"), "origin_group_id", "bucket", "selection_rank")


@query("""SELECT exact_digest, candidate_id FROM (SELECT exact_digest, candidate_id, row_number() OVER (PARTITION BY exact_digest ORDER BY bucket, selection_rank, candidate_id) AS k FROM candidates) WHERE k=1""")
def d7_exact_winners(spark, d):
    rows = table(spark, d, "candidates").select("exact_digest", "candidate_id", "bucket", "selection_rank")
    return dedup.first_per_key(rows, ["exact_digest"], F.col("bucket"), F.col("selection_rank"), F.col("candidate_id")).select("exact_digest", "candidate_id")


@query("SELECT DISTINCT exact_digest FROM candidates")
def d8_seen_set(spark, d):
    return table(spark, d, "candidates").select("exact_digest").dropDuplicates()


@query("""SELECT normalized_prompt, count(DISTINCT source_id||'/'||task) AS n_entries, string_agg(DISTINCT source_id||'/'||task, ',' ORDER BY source_id||'/'||task) AS entries FROM eval_reference GROUP BY normalized_prompt""")
def d9_pattern_merge(spark, d):
    got = dedup.merged(table(spark, d, "eval_reference").withColumn("entry", F.concat_ws("/", "source_id", "task")), "normalized_prompt", "entry")
    return got.select("normalized_prompt", F.size("entries").cast("long").alias("n_entries"), F.array_join("entries.entry", ",").alias("entries"))


@query("""SELECT candidate_id, s AS split_name FROM (SELECT candidate_id, s, row_number() OVER (PARTITION BY prompt_norm ORDER BY CASE s WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, candidate_id) AS k
 FROM (SELECT DISTINCT candidate_id, prompt_norm, lower(trim(split)) AS s FROM candidates)) WHERE k=1""")
def d10_cross_split_prompts(spark, d):
    split = F.lower(F.trim("split"))
    rows = table(spark, d, "candidates").select("candidate_id", X.key128(F.col("prompt_norm")).alias("prompt"), split.alias("split_name"))
    rank = F.when(F.col("split_name") == "train", 0).when(F.col("split_name") == "validation", 1).otherwise(2)
    return dedup.first_per_key(rows, ["prompt"], rank, F.col("candidate_id")).select("candidate_id", "split_name")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.candidate_id AS a, b.candidate_id AS b FROM pretrain_records a JOIN pretrain_records b ON a.content_sha256=b.content_sha256 AND a.candidate_id<>b.candidate_id),
 r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y=e.a) SELECT x AS id, least(x, min(y)) AS component FROM r GROUP BY x""")
def d11_components(spark, d):
    rows = table(spark, d, "pretrain_records").select("candidate_id", "content_sha256").distinct()
    first = rows.groupBy("content_sha256").agg(F.min("candidate_id").alias("b"))
    edges = rows.join(first, "content_sha256").filter("candidate_id <> b").select(F.col("candidate_id").alias("a"), "b")
    return dedup.components(edges)


_D = f"(SELECT doc_id, {_N1.format(c='text')} AS norm FROM documents WHERE text IS NOT NULL)"
_E = f"(SELECT item_id, {_N1.format(c='normalized_prompt')} AS p FROM eval_reference)"


@query(f"SELECT DISTINCT d.doc_id, e.item_id FROM {_D} d JOIN {_E} e ON contains(d.norm, e.p) AND d.norm<>e.p AND length(e.p)>=20")
def j3_containment(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.alnum_lower(F.col("text")).alias("norm"))
    items = table(spark, d, "eval_reference").select("item_id", X.alnum_lower(F.col("normalized_prompt")).alias("p"))
    return contamination.contained(docs, "doc_id", "norm", items, "item_id", "p").select(F.col("text_id").alias("doc_id"), F.col("pattern_id").alias("item_id"))


@query(f"SELECT DISTINCT e.item_id, d.doc_id FROM {_D} d JOIN {_E} e ON contains(e.p, d.norm) AND d.norm<>e.p AND length(d.norm)>=20")
def j2_reverse_containment(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.alnum_lower(F.col("text")).alias("norm")).filter(F.length("norm") >= 20)
    items = table(spark, d, "eval_reference").select("item_id", X.alnum_lower(F.col("normalized_prompt")).alias("p"))
    windows = items.select("item_id", "p", F.explode(X.shingles(F.col("p"), 20, "none")).alias("anchor"))
    hits = docs.withColumn("anchor", F.substring("norm", 1, 20)).join(windows, "anchor").filter(F.contains("p", "norm") & (F.col("p") != F.col("norm")))
    return hits.select("item_id", "doc_id").distinct()


def _near_test_items(spark, d, distance):
    """``(record_table, record_key, item_id, jaccard)`` of candidates' prompts and documents near a test item."""
    items = table(spark, d, "eval_reference")
    prompts = contamination.near_items(table(spark, d, "candidates"), "candidate_id", "prompt_norm", items, "item_id", "normalized_prompt", distance=distance)
    docs = contamination.near_items(table(spark, d, "documents"), "doc_id", "text", items, "item_id", "normalized_prompt", distance=distance, form=spaced)
    named = lambda df, name: df.select(F.lit(name).alias("record_table"), F.col("text_id").cast("string").alias("record_key"), "item_id", "jaccard")
    return named(prompts, "candidates").unionByName(named(docs, "documents"))


@query()
def j4_simhash_pairs(spark, d):
    """Training text near a test item by SimHash bands, at most 20 bits apart, 0.8 <= Jaccard < 1."""
    return _near_test_items(spark, d, 20)


@query()
def j5_minhash_pairs(spark, d):
    return contamination.minhash_pairs(table(spark, d, "candidates"), "candidate_id", "prompt_norm")


_G = "list_distinct(list_transform(range(1, length(t)-3), lambda i: substr(t,i,5)))"


@query(f"""WITH t AS (SELECT min(item_id) AS id, normalized_prompt AS t FROM eval_reference GROUP BY normalized_prompt), g AS (SELECT id, {_G} AS g FROM t), u AS (SELECT id, len(g) AS n, unnest(g) AS x FROM g)
 SELECT a.id AS id_a, b.id AS id_b, count(*)::DOUBLE/(a.n+b.n-count(*)) AS jaccard FROM u a JOIN u b ON a.x=b.x AND a.id<b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.8*(a.n+b.n-count(*))""")
def j6_gram_pairs(spark, d):
    """Test items among themselves; training text against them is j6_training_pairs."""
    return contamination.gram_pairs(table(spark, d, "eval_reference"), "item_id", "normalized_prompt")


@query()
def j6_training_pairs(spark, d):
    """All training text with a Jaccard of at least 0.8 to a test item, equal text included."""
    return _near_test_items(spark, d, None)


@query("""SELECT count(*) FILTER (WHERE c.first_line IS NULL) AS unmatched_records, count(*) FILTER (WHERE p.line_number IS NULL) AS orphan_chunks, count(*) FILTER (WHERE c.first_line IS NOT NULL AND p.line_number IS NOT NULL) AS matched
 FROM (SELECT DISTINCT shard, line_number FROM pretrain_records) p FULL JOIN (SELECT DISTINCT first_shard, first_line FROM (SELECT * FROM train_chunks UNION ALL SELECT * FROM validation_chunks)) c ON p.shard=c.first_shard AND p.line_number=c.first_line""")
def j7_provenance_join(spark, d):
    p = table(spark, d, "pretrain_records").select("shard", "line_number").distinct()
    c = table(spark, d, "train_chunks").unionByName(table(spark, d, "validation_chunks")).select(F.col("first_shard").alias("shard"), F.col("first_line").alias("line_number"), F.lit(True).alias("c")).distinct()
    both = p.withColumn("p", F.lit(True)).join(c, ["shard", "line_number"], "full")
    return both.agg(F.count_if(F.col("c").isNull()).alias("unmatched_records"), F.count_if(F.col("p").isNull()).alias("orphan_chunks"), F.count_if(F.col("c") & F.col("p")).alias("matched"))


@query("""SELECT s.source_id, coalesce(p.n,0) AS n_rows FROM sources s LEFT JOIN (SELECT lower(replace(trim(source),'-','_')) AS source_id, count(*) AS n FROM pretrain_records GROUP BY ALL) p USING (source_id)""")
def q2_declared_vs_observed(spark, d):
    seen = table(spark, d, "pretrain_records").groupBy(F.lower(F.replace(F.trim("source"), F.lit("-"), F.lit("_"))).alias("source_id")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "sources").select("source_id").join(seen, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("""SELECT candidate_id FROM candidates WHERE lower(trim(split))='train' AND prompt_norm NOT IN (SELECT prompt_norm FROM candidates WHERE lower(trim(split))<>'train')""")
def j9_drop_overlapping(spark, d):
    """The exact step between the splits; the whole guard is j9_guard."""
    rows = table(spark, d, "candidates").select("candidate_id", X.key128(F.col("prompt_norm")).alias("prompt"), F.lower(F.trim("split")).alias("s"))
    return rows.filter("s = 'train'").join(rows.filter("s <> 'train'").select("prompt").distinct(), "prompt", "left_anti").select("candidate_id")


@query()
def j9_guard(spark, d):
    """``(candidate_id, reason)`` of all train candidates: exact, containment or near to a held-out prompt or test item, whichever is first; null if none.

    Containment is either way and from 20 characters, near is a Jaccard of at
    least 0.8. A missing prompt has no reason.
    """
    rows = table(spark, d, "candidates").select("candidate_id", F.col("prompt_norm").alias("text"), F.lower(F.trim("split")).alias("s"))
    keyed = lambda df: df.filter("text is not null").select(F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("id"), "text").dropDuplicates(["id"])
    train = rows.filter("s = 'train'")
    held = written(keyed(rows.filter("s <> 'train'").select("text").unionByName(table(spark, d, "eval_reference").select(F.col("normalized_prompt").alias("text")))))
    prompts = keyed(train)
    exact = prompts.join(held, "id", "left_semi").select("id")
    rest = written(prompts.join(held, "id", "left_anti"))
    around = contamination.containment_pairs(rest, held).select(F.col("id_a").alias("id"))
    within = contamination.containment_pairs(held, rest).select(F.col("id_b").alias("id"))
    contained = written(around.unionByName(within).distinct())
    near = contamination.gram_pairs_across(rest.join(contained, "id", "left_anti"), held).select(F.col("id_a").alias("id")).distinct()
    steps = zip((exact, contained, near), ("exact", "containment", "near"))
    reasons = reduce(lambda x, y: x.unionByName(y), (df.withColumn("reason", F.lit(name)) for df, name in steps))
    of = train.select("candidate_id", F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("id"))
    return of.join(reasons, "id", "left").select("candidate_id", "reason")


@query("SELECT record_id, line_number FROM raw_pairs WHERE line_number IN (SELECT source_line_number FROM eval_reference)")
def j10_semi_join(spark, d):
    lines = table(spark, d, "eval_reference").select(F.col("source_line_number").alias("line_number"))
    return table(spark, d, "raw_pairs").join(lines, "line_number", "left_semi").select("record_id", "line_number")


@query("""WITH RECURSIVE t AS (SELECT candidate_id AS id, piece_of AS parent FROM pretrain_records WHERE piece_of IS NOT NULL), roots AS (SELECT id, parent, 1 AS depth FROM t UNION SELECT r.id, t.parent, r.depth+1 FROM roots r JOIN t ON r.parent=t.id WHERE r.depth < 31)
 SELECT id, max(depth)::BIGINT AS depth FROM roots GROUP BY id""")
def j13_tree_depth(spark, d):
    edges = table(spark, d, "pretrain_records").filter("piece_of is not null").select(F.col("candidate_id").alias("id"), F.col("piece_of").alias("parent")).distinct()
    walk, out = edges.withColumn("depth", F.lit(1).cast("long")), None
    out = walk
    for depth in range(2, 32):
        up = edges.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        walk = walk.join(up, "parent").select("id", F.col("next").alias("parent"), F.lit(depth).cast("long").alias("depth"))
        if walk.isEmpty():
            break
        out = out.unionByName(walk)
    return out.groupBy("id").agg(F.max("depth").alias("depth"))


@query("""WITH s AS (SELECT DISTINCT prompt_norm, lower(trim(split)) AS s FROM candidates) SELECT a.s AS split_a, b.s AS split_b, count(*) AS shared FROM s a JOIN s b USING (prompt_norm) WHERE a.s < b.s GROUP BY ALL""")
def j14_overlap_matrix(spark, d):
    sets = table(spark, d, "candidates").filter("prompt_norm is not null").groupBy(X.key128(F.col("prompt_norm"))).agg(F.sort_array(F.collect_set(F.lower(F.trim("split")))).alias("s")).filter(F.size("s") > 1)
    pairs = sets.select(F.explode("s").alias("split_a"), "s").select("split_a", F.explode("s").alias("split_b")).filter("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared"))


@query("""SELECT a.range AS a, b.range AS b, a.range+b.range AS answer FROM range(0,60) a, range(0,60) b WHERE (a.range+b.range)%10=7""")
def j15_operand_grid(spark, d):
    a, b = spark.range(60).select(F.col("id").alias("a")), spark.range(60).select(F.col("id").alias("b"))
    return a.crossJoin(b).withColumn("answer", F.col("a") + F.col("b")).filter("answer % 10 = 7")


@query("""WITH f AS (SELECT mix_id, unit_id, 10007*target_share AS x, floor(10007*target_share+1e-9)::BIGINT AS f FROM mix_targets),
 r AS (SELECT *, row_number() OVER (PARTITION BY mix_id ORDER BY round(x-f,9) DESC, unit_id DESC) AS k, 10007-sum(f) OVER (PARTITION BY mix_id) AS rest FROM f) SELECT mix_id, unit_id, (f + CASE WHEN k<=rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""")
def o7_largest_remainder(spark, d):
    return budget.largest_remainder(table(spark, d, "mix_targets"), 10007, "target_share", "unit_id", by=["mix_id"]).select("mix_id", "unit_id", "quota")


@query("""WITH f AS (SELECT mix_id, unit_id, floor(10007*target_share+1e-9)::BIGINT AS f FROM mix_targets), w AS (SELECT *, max(unit_id) OVER (PARTITION BY mix_id) AS last, sum(f) OVER (PARTITION BY mix_id) AS s FROM f) SELECT mix_id, unit_id, (CASE WHEN unit_id=last THEN 10007-s+f ELSE f END)::BIGINT AS quota FROM w""")
def o8_floor_quotas(spark, d):
    return budget.floor_quotas(table(spark, d, "mix_targets"), 10007, "target_share", "unit_id", by=["mix_id"]).select("mix_id", "unit_id", "quota")


@query("""WITH q AS (SELECT mix_id, CASE mix_id WHEN 'pretrain_a' THEN 6000 ELSE 4000 END AS t, unit_id, target_share FROM mix_targets WHERE unit_kind='source'), f AS (SELECT *, t*target_share AS x, floor(t*target_share+1e-9)::BIGINT AS f FROM q),
 r AS (SELECT *, row_number() OVER (PARTITION BY mix_id ORDER BY round(x-f,9) DESC, unit_id DESC) AS k, t-sum(f) OVER (PARTITION BY mix_id) AS rest FROM f) SELECT mix_id, unit_id, (f+CASE WHEN k<=rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""")
def o9_two_level_budget(spark, d):
    rows = table(spark, d, "mix_targets").filter("unit_kind = 'source'").withColumn("t", F.when(F.col("mix_id") == "pretrain_a", 6000).otherwise(4000))
    return budget.largest_remainder(rows, F.col("t"), "target_share", "unit_id", by=["mix_id"]).select("mix_id", "unit_id", "quota")


_B = "(SELECT DISTINCT candidate_id, bucket, lower(trim(split)) AS s, valid_targets AS n, sha256('7|'||candidate_id) AS h FROM candidates)"


def _buckets(spark, d):
    return table(spark, d, "candidates").select("candidate_id", "bucket", F.lower(F.trim("split")).alias("s"), F.col("valid_targets").alias("n")).distinct().withColumn("h", X.hash_order("7", F.col("candidate_id")))


@query(f"""SELECT candidate_id, bucket, s, before FROM (SELECT *, (sum(n) OVER (PARTITION BY s, bucket ORDER BY h) - n)::BIGINT AS before FROM {_B}) WHERE before < 900""")
def o10_greedy_budget(spark, d):
    return budget.take_budget(_buckets(spark, d), "n", 900, ["s", "bucket"], F.col("h")).select("candidate_id", "bucket", "s", "before")


@query("""SELECT shard, candidate_id FROM (SELECT shard, candidate_id, row_number() OVER (PARTITION BY shard ORDER BY sha256('bk|'||candidate_id)) AS k FROM (SELECT DISTINCT shard, candidate_id FROM pretrain_records)) WHERE k<=32""")
def o4_bottom_k(spark, d):
    rows = table(spark, d, "pretrain_records").select("shard", "candidate_id").distinct()
    return budget.bottom_k(rows, 32, ["shard"], X.hash_order("bk", F.col("candidate_id"))).select("shard", "candidate_id")


@query("""SELECT o_orderkey, (row_number() OVER (ORDER BY sha256('s|'||o_orderkey::VARCHAR)) - 1)::BIGINT AS place, ((row_number() OVER (ORDER BY sha256('s|'||o_orderkey::VARCHAR)) - 1) % 16)::BIGINT AS shard FROM orders""")
def s15_round_robin_shards(spark, d):
    """Hash order and round-robin shards over the whole table, ranked without one task that sorts all."""
    rows = table(spark, d, "orders").select("o_orderkey").withColumn("h", X.hash_order("s", F.col("o_orderkey")))
    return budget.ranked(rows, "place", F.col("h")).select("o_orderkey", "place", (F.col("place") % 16).alias("shard"))


_H8 = "('0x'||substr(sha256(prompt_norm),1,8))::BIGINT"


@query(f"""SELECT DISTINCT candidate_id, CASE WHEN {_H8}%100<2 THEN 'validation' WHEN {_H8}%100<4 THEN 'test' ELSE 'train' END AS split96, CASE WHEN {_H8}%10000<200 THEN 'validation' WHEN {_H8}%10000<400 THEN 'test' ELSE 'train' END AS split2,
 CASE WHEN {_H8}%1000<50 THEN 'validation' WHEN {_H8}%1000<100 THEN 'test' ELSE 'train' END AS split90, {_H8}%2=1 AS swapped FROM candidates""")
def o13_hash_splits(spark, d):
    h = F.sha2("prompt_norm", 256)
    split = lambda m, a, b: budget.hash_split(X.hash_mod(h, m), [("validation", a), ("test", b)], "train")
    return table(spark, d, "candidates").select("candidate_id", split(100, 2, 4).alias("split96"), split(10000, 200, 400).alias("split2"), split(1000, 50, 100).alias("split90"), (X.hash_mod(h, 2) == 1).alias("swapped")).distinct()


@query("""SELECT c_custkey, CASE WHEN k<=100 THEN 'validation' WHEN k<=200 THEN 'test' ELSE 'train' END AS split FROM (SELECT c_custkey, row_number() OVER (ORDER BY sha256('r|'||c_custkey::VARCHAR)) AS k FROM customer)""")
def o16_rank_split(spark, d):
    rows = table(spark, d, "customer").select("c_custkey").withColumn("h", X.hash_order("r", F.col("c_custkey")))
    return budget.ranked(rows, "k", F.col("h")).select("c_custkey", budget.hash_split(F.col("k"), [("validation", 100), ("test", 200)], "train").alias("split"))


@query("""SELECT task, item_id FROM (SELECT task, item_id, row_number() OVER (PARTITION BY task ORDER BY sha256('st|'||item_id::VARCHAR)) AS k FROM eval_reference) WHERE k<=10""")
def o17_stratified_counts(spark, d):
    return budget.bottom_k(table(spark, d, "eval_reference").select("task", "item_id"), 10, ["task"], X.hash_order("st", F.col("item_id"))).select("task", "item_id")


@query("""SELECT piece_of, arg_min(candidate_id, sha256(candidate_id)) AS chosen FROM pretrain_records WHERE piece_of IS NOT NULL GROUP BY piece_of""")
def o19_chunk_choice(spark, d):
    return table(spark, d, "pretrain_records").filter("piece_of is not null").groupBy("piece_of").agg(F.min_by("candidate_id", F.sha2("candidate_id", 256)).alias("chosen"))


@query("""SELECT event_id, event_id % 8 = 3 AS mine, event_id // 64 AS batch, (event_id + 17) % 1000 AS wrapped FROM events WHERE event_id // 64 >= 5""")
def o22_strides_and_batches(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").filter("event_id div 64 >= 5").select("event_id", (e % 8 == 3).alias("mine"), F.expr("event_id div 64").alias("batch"), ((e + 17) % 1000).alias("wrapped"))


@query("""SELECT 'pretrain' AS origin, candidate_id FROM pretrain_records UNION ALL SELECT 'sft', candidate_id FROM candidates""")
def u1_union(spark, d):
    return table(spark, d, "pretrain_records").select(F.lit("pretrain").alias("origin"), "candidate_id").unionByName(table(spark, d, "candidates").select(F.lit("sft").alias("origin"), "candidate_id"))


@query("SELECT digest FROM train_chunks INTERSECT SELECT digest FROM validation_chunks")
def u2_intersection(spark, d):
    return table(spark, d, "train_chunks").select("digest").intersect(table(spark, d, "validation_chunks").select("digest"))


@query("""SELECT source_id FROM sources EXCEPT SELECT lower(replace(trim(source),'-','_')) FROM pretrain_records""")
def u3_difference(spark, d):
    return table(spark, d, "sources").select("source_id").subtract(table(spark, d, "pretrain_records").select(F.lower(F.replace(F.trim("source"), F.lit("-"), F.lit("_"))).alias("source_id")))


@query("""SELECT (SELECT count(*) FROM (SELECT digest FROM train_chunks EXCEPT SELECT unhex(content_sha256) FROM pretrain_records WHERE split='train'))=0 AND (SELECT count(*) FROM (SELECT unhex(content_sha256) FROM pretrain_records WHERE split='train' EXCEPT SELECT digest FROM train_chunks))=0 AS equal_sets""")
def u4_set_equality(spark, d):
    a = table(spark, d, "train_chunks").select("digest").distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "pretrain_records").filter("split = 'train'").select(F.unhex("content_sha256").alias("digest")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "digest", "full").agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("equal_sets"))
