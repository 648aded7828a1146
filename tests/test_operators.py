import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import budget, contamination, conversation, dedup, skew
from millrace.sources import files
from millrace.streaming import events as streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_per_key_is_order_free(spark):
    data = [("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), (None, 0, "w")]
    for parts in (1, 4):
        for order in (data, data[::-1]):
            df = spark.createDataFrame(order, "k string, o int, v string").repartition(parts)
            assert rows(dedup.first_per_key(df, ["k"], F.col("o"))) == [("a", 1, "y"), ("b", 2, "z")]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)]
    got = dict(rows(dedup.components(spark.createDataFrame(edges, "a long, b long"))))
    assert {v for k, v in got.items() if k <= 40} == {0} and {v for k, v in got.items() if k >= 100} == {100} and len(got) == 71


def test_greedy_keeps_what_a_sequential_pass_keeps(spark):
    edges = [(1, 2), (2, 3), (3, 4), (1, 5), (4, 5), (7, 8)]
    kept, near = [], {frozenset(e) for e in edges}
    for i in range(1, 10):
        if not any(frozenset((i, k)) in near for k in kept):
            kept.append(i)
    got = dedup.greedy(spark.range(1, 10), spark.createDataFrame(edges, "id_a long, id_b long"), lambda c: c)
    assert [r.id for r in got.orderBy("id").collect()] == kept


def test_budget_matches_a_running_sum(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold")).withColumn("n", F.col("id") % 7 + 1).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    want, total = set(), {}
    for r in df.orderBy("h").collect():
        if total.get(r.g, 0) < 100:
            want.add(r.id)
        total[r.g] = total.get(r.g, 0) + r.n
    got = budget.take_budget(df, "n", 100, ["g"], F.col("h"))
    assert {r.id for r in got.collect()} == want
    assert budget.take_budget(df, "n", 0, ["g"], F.col("h")).count() == 0


def test_ranks_are_dense_with_and_without_groups(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 3).withColumn("h", F.sha2(F.col("id").cast("string"), 256)).repartition(5)
    got = [r.id for r in budget.ranked(df, "k", F.col("h")).orderBy("k").collect()]
    assert got == [r.id for r in df.orderBy("h").collect()]
    by = budget.ranked(df, "k", F.col("h"), by=["g"]).groupBy("g").agg(F.min("k"), F.max("k"), F.countDistinct("k"), F.count("k")).collect()
    assert all(r[1] == 0 and r[2] + 1 == r[3] == r[4] for r in by)


def test_largest_remainder_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("a", 1 / 3), ("b", 1 / 3), ("c", 1 / 3)], "unit string, w double")
    assert rows(budget.largest_remainder(df, 10, "w", "unit").select("unit", "quota")) == [("a", 3), ("b", 3), ("c", 4)]


def test_containment_respects_length_and_equality(spark):
    p19, p20 = "x" * 19, "abcdefghij0123456789"
    texts = spark.createDataFrame([(1, "zz" + p20 + "zz"), (2, p20), (3, "q" + p19 + "q"), (4, None), (5, "")], "id long, t string")
    patterns = spark.createDataFrame([(10, p20), (11, p19), (12, p20), (13, None)], "pid long, p string")
    assert rows(contamination.contained(texts, "id", "t", patterns, "pid", "p")) == [(1, 10), (1, 12)]
    assert contamination.contained(texts, "id", "t", patterns.limit(0), "pid", "p").count() == 0


def test_near_pairs_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog while the river runs past the old mill and the wind turns the sails "
    texts = [base * 2, base * 2 + "now", (base * 2).replace("mill", "barn"), "something else entirely, with no words in common at all, really nothing", base * 2, "abc", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in enumerate(texts)}
    want = sorted((i, j) for i in sets for j in sets if i < j and texts[i] != texts[j] and (i, j) not in {(1, 4), (2, 4)} and sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    for fn in (contamination.gram_pairs, contamination.minhash_pairs, contamination.simhash_pairs):
        assert [r[:2] for r in rows(fn(df, "id", "t"))] == want, fn.__name__


def test_hot_groups_join_like_others(spark):
    left = spark.range(20_050).withColumn("k", F.when(F.col("id") < 20_000, "hot").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))))
    groups = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    got = skew.join_groups(left, groups, ["k"], "n", 20_050)
    assert got.count() == 20_050 and got.filter("k = 'hot' and first <> 0").count() == 0


def test_conversation_rules(spark):
    payloads = [
        [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}],
        [{"role": "user", "content": "a"}, {"role": "system", "content": "s"}, {"role": "assistant", "content": "b"}],
        [{"role": "user", "content": "a"}],
        [{"role": "king", "content": "a"}],
        [],
    ]
    df = conversation.parsed(spark.createDataFrame([(i, json.dumps({"conversations": p})) for i, p in enumerate(payloads)] + [(9, "no json"), (10, None)], "id int, payload_json string"))
    got = dict(rows(df.select("id", conversation.schema_reason(F.col("conv")))))
    assert got == {0: None, 1: "system_position", 2: "turns", 3: "role", 4: "empty", 9: "empty", 10: "empty"}
    chunks = df.limit(1).select(conversation.packed_turns(F.array(*map(F.lit, [3, 4, 9, 2, 5])), 8, 1).alias("c")).first().c
    assert chunks == [0, 0, -1, 1, 1]  # 1 + 3 + 4 and 1 + 2 + 5 just fit; 9 never does


def test_sources_and_sinks(spark, tmp_path):
    good, bad = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"text":"x"}\n{"text":"y"}\n')
    bad.write_text('{"text":"x"}\n\n{"text":\n[1]\n{"other":1}\n{"text":" "}\n')
    assert files.read_corpus(spark, str(good), "jsonl", schema="text string").count() == 2
    with pytest.raises(Exception):
        files.read_corpus(spark, str(bad), "jsonl", schema="text string").collect()
    report = files.json_line_report(spark, str(bad), ["text"]).first()
    assert (report.lines, report.blank, report.invalid_json, report.not_object, report.missing_field, report.empty) == (6, 1, 1, 1, 1, 1)
    out = str(tmp_path / "out")
    files.write_shards(spark.range(10), out, 3, F.col("id"))
    back = spark.read.parquet(out)
    assert rows(back.select("id", "shard", "line_number")) == [(i, i % 3, i // 3 + 1) for i in range(10)]
    with pytest.raises(Exception):
        files.write_new(spark.range(1), out)
    assert files.fingerprint(spark.range(100).repartition(7)) == files.fingerprint(spark.range(100)) != files.fingerprint(spark.range(101))
    with pytest.raises(ValueError):
        files.read_corpus(spark, out, "parquet", ["nothing"])


def test_marker_only_after_all_gates(spark, tmp_path):
    folder = str(tmp_path)
    gates = spark.createDataFrame([("a", True), ("b", False)], "gate string, passed boolean")
    assert not files.publish(gates, {"inputs": "1"}, folder) and not os.path.exists(f"{folder}/_SUCCESS")
    assert files.reusable(f"{folder}/report.json", "1") is None
    assert files.publish(gates.filter("passed"), {"inputs": "1"}, folder) and os.path.exists(f"{folder}/_SUCCESS")
    assert files.reusable(f"{folder}/report.json", "1") and files.reusable(f"{folder}/report.json", "2") is None


def test_streamed_first_seen_and_budget(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, "g", i, "2026-01-01 00:00:00") for i in range(20)], "key long, grp string, size long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert streams.run_once(streams.first_seen(stream(), "key")).count() == 5
    got = streams.run_once(streams.running_budget(stream(), "grp", "key", "size", 10))
    assert got.agg(F.sum("size")).first()[0] >= 10
