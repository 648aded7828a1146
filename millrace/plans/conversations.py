"""Conversations and rule checks over the candidate store."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import verify
from ..operators import conversation as C
from ..runtime import table
from .registry import query

_M = "unnest(CAST(json_extract(payload_json,'$.conversations[*]') AS JSON[]))"
_ROWS = f"(SELECT candidate_id, ingested_at, generate_subscripts(json_extract(payload_json,'$.conversations[*]'),1)-1 AS pos, {_M} AS m FROM candidates)"


def _conv(spark, d):
    return C.parsed(table(spark, d, "candidates").dropDuplicates(["candidate_id"]))


_ONE = f"(SELECT candidate_id, pos, m->>'role' AS role, m->>'content' AS content, m->>'tool_calls' AS tool_calls FROM {_ROWS} QUALIFY ingested_at = min(ingested_at) OVER (PARTITION BY candidate_id))"


@query(f"SELECT candidate_id, pos::INT AS pos, role, length(content)::INT AS chars FROM {_ONE}")
def c1_messages(spark, d):
    return _conv(spark, d).select("candidate_id", F.posexplode("conv").alias("pos", "m")).select("candidate_id", "pos", "m.role", F.length("m.content").alias("chars"))


@query(f"""WITH r AS (SELECT candidate_id, CASE WHEN count(*) FILTER (WHERE role IS NULL OR role NOT IN ('system','user','assistant','tool'))>0 THEN 'role' WHEN count(*) FILTER (WHERE role='system' AND pos>0)>0 THEN 'system_position'
 WHEN count(*) FILTER (WHERE trim(coalesce(content,''),' ')='' AND tool_calls IS NULL)>0 THEN 'content' WHEN count(*) FILTER (WHERE role='user')=0 OR count(*) FILTER (WHERE role='assistant')=0 THEN 'turns' END AS reason FROM {_ONE} GROUP BY candidate_id)
 SELECT coalesce(reason,'valid') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def c2_schema_validation(spark, d):
    return _conv(spark, d).groupBy(F.coalesce(C.schema_reason(F.col("conv")), F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT candidate_id, string_agg(coalesce(content,''), E'\\n' ORDER BY pos) AS prompt FROM {_ONE} WHERE role='user' GROUP BY candidate_id")
def c3_user_prompts(spark, d):
    return _conv(spark, d).select("candidate_id", C.user_prompt(F.col("conv")).alias("prompt"))


@query(f"""WITH t AS (SELECT *, sum((role='user')::INT) OVER (PARTITION BY candidate_id ORDER BY pos)::INT AS turn, coalesce(json_array_length(tool_calls),0)::INT AS calls, (role='tool')::INT AS answers FROM {_ONE})
 SELECT candidate_id, turn, count(*) AS messages, sum(calls)::BIGINT AS calls, sum(answers)::BIGINT AS answers, sum(calls)=sum(answers) AS settled FROM t GROUP BY candidate_id, turn""")
def c4_turns(spark, d):
    got = C.turns(_conv(spark, d), "candidate_id").groupBy("candidate_id", "turn").agg(F.count(F.lit(1)).alias("messages"), F.sum("calls").alias("calls"), F.sum("answers").alias("answers"))
    return got.withColumn("settled", F.col("calls") == F.col("answers"))


@query()
def c5_packed_turns(spark, d):
    sized = C.turns(_conv(spark, d), "candidate_id").groupBy("candidate_id", "turn").agg(F.sum(F.length(F.coalesce("content", F.lit("")))).alias("n"))
    rows = sized.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("turn", "n"))).alias("t"))
    return rows.select("candidate_id", C.packed_turns(F.transform("t", lambda x: x["n"]), 800).alias("chunks")).select("candidate_id", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",").alias("chunks"), (F.array_max("chunks") + 1).alias("n_chunks"))


@query(f"""SELECT candidate_id, count(*) FILTER (WHERE role='assistant')>=2 AS multiturn, bool_or(coalesce(tool_calls IS NOT NULL,false)) AS has_tools, c.valid_targets<=384 AS fits FROM {_ONE} m JOIN (SELECT DISTINCT candidate_id, valid_targets FROM candidates) c USING (candidate_id) GROUP BY candidate_id, c.valid_targets""")
def c6_bucket_eligibility(spark, d):
    conv = F.col("conv")
    return _conv(spark, d).select("candidate_id", (F.size(F.filter(conv, lambda m: m["role"] == "assistant")) >= 2).alias("multiturn"), F.exists(conv, lambda m: m["tool_calls"].isNotNull()).alias("has_tools"), (F.col("valid_targets") <= 384).alias("fits"))


@query(f"""SELECT candidate_id, string_agg('<|im_start|>'||role||E'\\n'||coalesce(content,'')||E'<|im_end|>\\n','' ORDER BY pos) AS rendered FROM (SELECT *, max(pos) OVER (PARTITION BY candidate_id) AS last FROM {_ONE}) WHERE pos<last GROUP BY candidate_id""")
def c7_prompt_only(spark, d):
    return _conv(spark, d).filter(F.size("conv") > 1).select("candidate_id", X.chat_prompt(C.without_last(F.col("conv"))).alias("rendered"))


@query(f"SELECT candidate_id, sha256(string_agg('<|im_start|>'||role||E'\\n'||coalesce(content,'')||E'<|im_end|>\\n','' ORDER BY pos)) AS rendered_sha FROM {_ONE} GROUP BY candidate_id")
def t36_chat_template(spark, d):
    return _conv(spark, d).select("candidate_id", F.sha2(X.chat_prompt(F.col("conv")), 256).alias("rendered_sha"))


@query(f"SELECT candidate_id, pos::INT AS pos, pos::INT AS context_size, content FROM {_ONE} WHERE role='assistant'")
def c10_decisions(spark, d):
    return C.decisions(_conv(spark, d), "candidate_id")


@query(f"SELECT candidate_id, pos::INT AS pos, trim(regexp_replace(coalesce(content,''),'(?s)^\\s*<think>.*?</think>',''),' ') AS answer FROM {_ONE} WHERE role='assistant'")
def t21_strip_thinking(spark, d):
    return C.decisions(_conv(spark, d), "candidate_id").select("candidate_id", "pos", X.strip_thinking(F.coalesce("content", F.lit(""))).alias("answer"))


def _answers(spark, d):
    conv = F.col("conv")
    return _conv(spark, d).select("candidate_id", C.user_prompt(conv).alias("prompt"), F.element_at(F.filter(conv, lambda m: m["role"] == "assistant"), -1)["content"].alias("answer"))


_VERDICT = T.StructType([T.StructField("status", T.StringType()), T.StructField("families", T.ArrayType(T.StringType())), T.StructField("broken", T.ArrayType(T.StringType()))])


@query()
def t26_constraint_verdicts(spark, d):
    judged = verify.vectorised(lambda p, a: json.dumps(verify.verdict(p, a)), T.StringType(), "prompt", "answer")
    rows = _answers(spark, d).select("candidate_id", F.from_json(judged, _VERDICT).alias("v"))
    return rows.select("candidate_id", "v.status", F.array_join("v.families", ",").alias("families"), F.array_join("v.broken", ",").alias("broken"))


@query()
def t33_embedded_json(spark, d):
    found = verify.vectorised(verify.embedded_json, T.ArrayType(T.StringType()), "answer")
    return _answers(spark, d).select("candidate_id", F.explode(found).alias("object"))


@query()
def t10_canonical_json(spark, d):
    return table(spark, d, "events").select("event_id", verify.vectorised(verify.canonical_json, T.StringType(), "props").alias("canonical"))


@query(f"""SELECT candidate_id, pos::INT AS pos, CASE WHEN length(regexp_replace(content,'[^一-鿿]','','g'))>=5 THEN 'zh' WHEN len(regexp_extract_all(lower(content),'\\b(the|and|of|to|is|that)\\b'))>=3 THEN 'en' ELSE 'unknown' END AS lang FROM {_ONE} WHERE role='assistant' AND content IS NOT NULL""")
def t25_language_guess(spark, d):
    t = F.col("content")
    lang = F.when(X.script_chars(t, "cjk") >= 5, "zh").when(X.count_of(F.lower(t), r"\b(the|and|of|to|is|that)\b") >= 3, "en").otherwise("unknown")
    return C.decisions(_conv(spark, d), "candidate_id").filter("content is not null").select("candidate_id", "pos", lang.alias("lang"))


@query()
def t31_tool_arguments(spark, d):
    """Each tool call against the schema of the tool of that name in the same conversation."""
    conv = F.col("conv")
    calls = F.from_json(F.col("m.tool_calls"), "array<struct<name: string, arguments: string>>")
    rows = _conv(spark, d).select("candidate_id", F.explode("conv").alias("m"), F.get(F.filter(F.transform(conv, lambda m: m["tools"]), lambda x: x.isNotNull()), F.lit(0)).alias("tools"))
    rows = rows.filter("m.tool_calls is not null").select("candidate_id", "tools", F.explode(calls).alias("c"))
    tools = F.from_json("tools", "array<struct<name: string, parameters: string>>")
    schema = F.get(F.filter(tools, lambda x: x["name"] == F.col("c.name")), F.lit(0))["parameters"]
    rows = rows.select("candidate_id", F.col("c.name").alias("tool"), F.col("c.arguments").alias("arguments"), schema.alias("spec"))
    return rows.select("candidate_id", "tool", F.coalesce(verify.vectorised(verify.tool_argument_fault, T.StringType(), "arguments", "spec"), F.lit("ok")).alias("fault"))


@query("""SELECT n AS task_id, a, b, a+b AS answer, 'What is '||a||' plus '||b||'?' AS prompt, CASE WHEN n%50=0 THEN 'validation' ELSE 'train' END AS split FROM (SELECT range AS n, range%97 AS a, (range*31)%89 AS b FROM range(0,2000))""")
def t38_generated_tasks(spark, d):
    n = F.col("task_id")
    rows = spark.range(2000).select(F.col("id").alias("task_id")).select("task_id", (n % 97).alias("a"), ((n * 31) % 89).alias("b"))
    return rows.select("*", (F.col("a") + F.col("b")).alias("answer"), F.format_string("What is %d plus %d?", "a", "b").alias("prompt"), F.when(n % 50 == 0, "validation").otherwise("train").alias("split"))


@query("""SELECT candidate_id, CASE WHEN substr(sha256('sys|'||candidate_id),1,16) < '3333333333333000' THEN 'You are a helpful assistant.' END AS system_prompt FROM (SELECT DISTINCT candidate_id FROM candidates)""")
def t37_random_system_prompt(spark, d):
    rows = table(spark, d, "candidates").select("candidate_id").distinct()
    return rows.select("candidate_id", F.when(X.sampled(X.hash_order("sys", F.col("candidate_id")), 0.2), "You are a helpful assistant.").alias("system_prompt"))


@query("""SELECT candidate_id, array_to_string(list_sort(json_keys(payload_json,'$.conversations[0]')),',') AS message_keys, json_keys(payload_json) = ['conversations'] AS exact_top FROM (SELECT DISTINCT candidate_id, payload_json FROM candidates)""")
def f14_exact_keys(spark, d):
    rows = table(spark, d, "candidates").select("candidate_id", "payload_json").distinct()
    first = F.get_json_object("payload_json", "$.conversations[0]")
    return rows.select("candidate_id", F.array_join(F.array_sort(F.json_object_keys(first)), ",").alias("message_keys"), (F.json_object_keys("payload_json") == F.array(F.lit("conversations"))).alias("exact_top"))
