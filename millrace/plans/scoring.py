"""Scores, rewards, losses and generators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores as S
from ..functions import text as X
from ..functions import verify
from ..functions.unicode import spaced
from ..operators import budget, contamination, dedup
from ..operators import conversation as C
from ..operators.quantiles import exact_quantiles
from ..runtime import table
from .conversations import _ONE, _conv
from .registry import query

#: Draws of a bootstrap.
REPLICATES = 10_000


@query(f"""WITH e AS (SELECT user_id, avg(value) FILTER (WHERE event_type='click') AS a, avg(value) FILTER (WHERE event_type='view') AS b, count(*) FILTER (WHERE event_type='view')>count(*) FILTER (WHERE event_type='click') AS longer FROM events GROUP BY user_id)
 SELECT coalesce(longer, false) AS longer, count(*) AS pairs, avg(CASE WHEN abs(a-b)<=1e-7 THEN 0.5 WHEN b>a THEN 1 ELSE 0 END) AS credit FROM e WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL""")
def a21_preference_credit(spark, d):
    """Credit of the second run, ties a half, for those that are longer and those that aren't."""
    on = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    e = table(spark, d, "events").groupBy("user_id").agg(F.avg(on("click")).alias("a"), F.avg(on("view")).alias("b"), (F.count_if(F.col("event_type") == "view") > F.count_if(F.col("event_type") == "click")).alias("longer"))
    return e.filter("a is not null and b is not null").groupBy("longer").agg(F.count(F.lit(1)).alias("pairs"), F.avg(S.credit(F.col("a"), F.col("b"))).alias("credit"))


@query(f"""WITH p AS (SELECT task, item_id, CASE WHEN length(normalized_prompt)%3=0 THEN 1.0 WHEN length(normalized_prompt)%3=1 THEN 0.5 ELSE 0.0 END AS score FROM eval_reference), n AS (SELECT task, count(*) AS n FROM p GROUP BY task), r AS (SELECT p.*, n.n, row_number() OVER (PARTITION BY p.task ORDER BY item_id)-1 AS k FROM p JOIN n USING (task)),
 s AS (SELECT task, g.range AS rep, n, unnest(list_transform(range(0,n), lambda i: (('0x'||substr(sha256(task||'|'||g.range||'|'||(i//8)),1+8*(i%8)::INT,8))::BIGINT % n))) AS draw FROM n CROSS JOIN range(0,{REPLICATES}) g), m AS (SELECT s.task, s.rep, sum(r.score)/any_value(s.n) AS mean FROM s JOIN r ON r.task=s.task AND r.k=s.draw GROUP BY s.task, s.rep)
 SELECT m.task, (SELECT avg(score) FROM p WHERE p.task=m.task) AS score, quantile_cont(mean,0.025) AS low, quantile_cont(mean,0.975) AS high, any_value(c.wins) AS wins, any_value(c.ties) AS ties FROM m JOIN (SELECT task, count(*) FILTER (WHERE score=1) AS wins, count(*) FILTER (WHERE score=0.5) AS ties FROM p GROUP BY task) c USING (task) GROUP BY m.task""")
def a39_blind_score(spark, d):
    """Blind comparison per task, ties a half, with a bootstrap interval of 10,000 draws."""
    n = F.length("normalized_prompt") % 3
    rows = table(spark, d, "eval_reference").select("task", "item_id", F.when(n == 0, 1.0).when(n == 1, 0.5).otherwise(0.0).alias("score"))
    told = rows.groupBy("task").agg(F.avg("score").alias("score"), F.count_if(F.col("score") == 1).alias("wins"), F.count_if(F.col("score") == 0.5).alias("ties"))
    means = S.bootstrap_means(rows, ["task"], "score", F.col("item_id"), REPLICATES)
    ends = means.groupBy("task").agg(F.expr("percentile(mean, 0.025)").alias("low"), F.expr("percentile(mean, 0.975)").alias("high"))
    return told.join(ends, "task").select("task", "score", "low", "high", "wins", "ties")


@query("""WITH r AS (SELECT vec_id//4 AS grp, list_transform(embedding[1:8], lambda x: x>0) AS got, list_transform(embedding[1:8], lambda x: x>-0.12) AS want FROM embeddings), s AS (SELECT grp, got=want AS success, coalesce(list_min(list_filter(range(1,9), lambda i: got[i]<>want[i]))-1, 8) AS prefix FROM r), w AS (SELECT grp, 0.8*success::INT+0.2*prefix/8 AS reward FROM s),
 g AS (SELECT grp, stddev_pop(reward) AS sd, avg(reward) AS mean FROM w GROUP BY grp) SELECT count(*) AS groups_, avg((sd<1e-8)::INT) AS zero_variance, avg(sd) AS mean_sd, avg(mean) AS mean_reward FROM g""")
def a40_prefix_reward(spark, d):
    """Reward of episodes: success and the share of calls that are right from the first on; how many groups of four have no spread."""
    flags = lambda limit: F.transform(F.slice("embedding", 1, 8), lambda x: x > limit)
    rows = table(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("grp"), flags(0.0).alias("got"), flags(-0.12).alias("want"))
    g = rows.select("grp", S.episode_reward(F.col("got"), F.col("want")).alias("reward")).groupBy("grp").agg(F.stddev_pop("reward").alias("sd"), F.avg("reward").alias("mean"))
    return g.agg(F.count(F.lit(1)).alias("groups_"), F.avg((F.col("sd") < 1e-8).cast("int")).alias("zero_variance"), F.avg("sd").alias("mean_sd"), F.avg("mean").alias("mean_reward"))


_V = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_MASKED = "list_sum(list_transform(range(1, least(len({x}), 48)+1), lambda i: {x}[i]))"


@query(f"""WITH p AS (SELECT a.vec_id//4 AS pair, {_MASKED.format(x='a.v')} AS chosen, {_MASKED.format(x='b.v')} AS rejected, {_MASKED.format(x='c.v')} AS ref_chosen, {_MASKED.format(x='d.v')} AS ref_rejected FROM {_V} a JOIN {_V} b ON b.vec_id=a.vec_id+1 JOIN {_V} c ON c.vec_id=a.vec_id+2 JOIN {_V} d ON d.vec_id=a.vec_id+3 WHERE a.vec_id%4=0)
 SELECT count(*) AS pairs, avg(ln(1+exp(-0.1*((chosen-rejected)-(ref_chosen-ref_rejected))))) AS loss, avg(((chosen-rejected)>(ref_chosen-ref_rejected))::INT) AS better FROM p""")
def a41_preference_loss_masked(spark, d):
    """Preference loss from masked sums of token log-probabilities of policy and reference on either answer."""
    rows = table(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("pair"), (F.col("vec_id") % 4).alias("k"), S.masked_sum(F.transform("embedding", lambda x: x.cast("double")), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: (i < 48).cast("int"))).alias("s"))
    one = lambda k: F.max(F.when(F.col("k") == k, F.col("s")))
    p = rows.groupBy("pair").agg(one(0).alias("chosen"), one(1).alias("rejected"), one(2).alias("ref_chosen"), one(3).alias("ref_rejected")).dropna()
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.avg(S.preference_loss(F.col("chosen"), F.col("rejected"), F.col("ref_chosen"), F.col("ref_rejected"), 0.1)).alias("loss"), F.avg((F.col("chosen") - F.col("rejected") > F.col("ref_chosen") - F.col("ref_rejected")).cast("int")).alias("better"))


_POLICY = """WITH p AS (SELECT a.v AS new, b.v AS old, c.v AS ref, a.vec_id%7-3.0 AS adv, 1+a.vec_id%64 AS upto FROM {v} a JOIN {v} b ON b.vec_id=a.vec_id+1 JOIN {v} c ON c.vec_id=a.vec_id+2 WHERE a.vec_id%3=0),
 t AS (SELECT upto, list_transform(range(1,65), lambda i: CASE WHEN i<=upto THEN -(least(exp(new[i]-old[i])*adv, greatest(0.8,least(1.2,exp(new[i]-old[i])))*adv) - 0.04*(exp(ref[i]-new[i])-(ref[i]-new[i])-1)) ELSE 0 END) AS l,
 list_transform(range(1,65), lambda i: CASE WHEN i<=upto THEN -(least(exp(new[i]-old[i]),5.0)*adv*new[i] - 0.04*(exp(ref[i]-new[i])-(ref[i]-new[i])-1)) ELSE 0 END) AS c FROM p) SELECT count(*) AS n_rows, avg(list_sum(l)/greatest(1,upto)) AS clipped_loss, avg(list_sum(c)/greatest(1,upto)) AS clamped_loss FROM t"""


@query(_POLICY.format(v=_V))
def a42_policy_loss_masked(spark, d):
    """Both policy losses, with the divergence from the reference, as the mean over rows of the mean over unmasked tokens."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = e.filter("vec_id % 3 = 0").select("vec_id", F.col("v").alias("new"))
    for shift, name in ((1, "old"), (2, "ref")):
        rows = rows.join(e.select((F.col("vec_id") - shift).alias("vec_id"), F.col("v").alias(name)), "vec_id")
    upto = (1 + F.col("vec_id") % 64).cast("int")
    rows = rows.withColumn("mask", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i <= upto).cast("int"))).withColumn("adv", F.col("vec_id") % 7 - 3.0)
    loss = lambda kind: F.avg(S.policy_loss(F.col("new"), F.col("old"), F.col("ref"), F.col("mask"), F.col("adv"), kind))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), loss("clipped").alias("clipped_loss"), loss("clamped").alias("clamped_loss"))


_ANSWERS = f"(SELECT candidate_id, pos::INT AS pos, content AS t FROM {_ONE} WHERE role='assistant' AND content IS NOT NULL)"


def _answers(spark, d):
    return C.decisions(_conv(spark, d), "candidate_id").filter("content is not null").select("candidate_id", "pos", F.col("content").alias("t"))


@query(f"""SELECT candidate_id, pos, len(list_filter(regexp_split_to_array(t,'\\s+'), lambda w: w<>''))::BIGINT AS words, len(list_filter(regexp_split_to_array(t,'\\n[ \\t]*\\n'), lambda p: trim(p,' ')<>'' AND trim(p, chr(10))<>''))::BIGINT AS paragraphs, len(list_filter(regexp_split_to_array(t,'[.!?。！？]+'), lambda p: regexp_matches(p,'\\S')))::BIGINT AS sentences,
 len(regexp_extract_all(t,'\\*\\*[^*\\n]+\\*\\*'))::BIGINT AS bold, len(regexp_extract_all(regexp_replace(t,'\\*\\*[^*\\n]*\\*\\*','','g'),'\\*[^*\\n]+\\*'))::BIGINT AS italic FROM {_ANSWERS}""")
def t22_answer_counts(spark, d):
    """Words, paragraphs, sentences and highlighted spans (bold, and italic that isn't bold) of every answer."""
    t = F.col("t")
    paragraphs = F.filter(F.split(t, r"\n[ \t]*\n"), lambda p: (F.trim(p) != "") & (F.regexp_replace(p, "^\n+|\n+$", "") != ""))
    italic = X.count_of(F.regexp_replace(t, r"\*\*[^*\n]*\*\*", ""), r"\*[^*\n]+\*")
    return _answers(spark, d).select(
        "candidate_id", "pos", X.word_count(t).cast("long").alias("words"), F.size(paragraphs).cast("long").alias("paragraphs"), F.size(F.filter(F.split(t, r"[.!?。！？]+"), lambda p: p.rlike(r"\S"))).cast("long").alias("sentences"),
        X.count_of(t, r"\*\*[^*\n]+\*\*").cast("long").alias("bold"), italic.cast("long").alias("italic"),
    )


@query("""SELECT item_id, len(g)::BIGINT AS grams, list_sort(list_transform(g, lambda x: sha256(x)))[1] AS least FROM (SELECT item_id, CASE WHEN length(normalized_prompt)<5 THEN [] ELSE list_distinct(list_transform(range(1, length(normalized_prompt)-3), lambda i: substr(normalized_prompt,i,5))) END AS g FROM eval_reference)""")
def t3_hashed_shingles(spark, d):
    """Character shingles as hashes; short texts have none."""
    g = X.shingles(F.col("normalized_prompt"), 5, "none")
    return table(spark, d, "eval_reference").select("item_id", F.size(g).cast("long").alias("grams"), F.array_min(F.transform(g, lambda x: F.sha2(x, 256))).alias("least"))


@query(f"""WITH r AS (SELECT candidate_id, pos, t, pos*7 % 1000 AS want FROM {_ANSWERS}) SELECT candidate_id, pos, list_contains(list_transform(regexp_extract_all(replace(t,',',''),'(?:^|[^\\w.+-])([-+]?[0-9]+(?:\\.[0-9]+)?)',1), lambda x: abs(x::DOUBLE-length(t)%100)<1e-6), true) AS verified FROM r""")
def t29_number_in_text(spark, d):
    """Whether the number wanted stands in the answer as a number of its own, digits grouped by commas or not."""
    return _answers(spark, d).select("candidate_id", "pos", S.number_in_text(F.col("t"), F.length("t") % 100).alias("verified"))


@query(f"""SELECT candidate_id, pos::INT AS pos, json_extract_string(c,'$.name') AS tool, json_extract_string(c,'$.name') IS NOT NULL AND json_type(c,'$.arguments')='OBJECT' AS readable FROM (SELECT candidate_id, pos, unnest(regexp_extract_all('<tool_call>'||replace(json_extract(tool_calls,'$[0]')::VARCHAR,chr(10),' ')||'</tool_call> <tool_call>broken</tool_call>','<tool_call>(.*?)</tool_call>',1)) AS c FROM {_ONE} WHERE role='assistant' AND tool_calls IS NOT NULL AND json_valid(tool_calls) AND json_array_length(tool_calls)>0) WHERE json_valid(c)""")
def t30_tool_call_extraction(spark, d):
    """Tool calls between their tags in rendered answers; what isn't JSON is left out."""
    first = F.get_json_object("m.tool_calls", "$[0]")
    rows = _conv(spark, d).select("candidate_id", F.posexplode("conv").alias("pos", "m")).filter("m.role = 'assistant'").filter(F.json_array_length("m.tool_calls") > 0)
    rendered = F.concat(F.lit("<tool_call>"), F.replace(first, F.lit("\n"), F.lit(" ")), F.lit("</tool_call> <tool_call>broken</tool_call>"))
    return rows.select("candidate_id", "pos", F.explode(X.tool_calls(rendered)).alias("c")).filter(F.try_parse_json("c").isNotNull()).select("candidate_id", "pos", F.get_json_object("c", "$.name").alias("tool"), (F.get_json_object("c", "$.name").isNotNull() & F.startswith(F.coalesce(F.get_json_object("c", "$.arguments"), F.lit("")), F.lit("{"))).alias("readable"))


@query()
def t34_marked_chats(spark, d):
    """Candidates' conversations written with markers and read back: messages that come back as they were."""
    conv = F.filter("conv", lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) != "")
    name = lambda m: F.when(m["role"] == "tool", "FUNCTION RESPONSE").otherwise(F.upper(m["role"]))
    rows = _conv(spark, d).select("candidate_id", F.size(conv).alias("stored"), F.array_join(F.transform(conv, lambda m: F.concat(name(m), F.lit(": "), m["content"])), "\n").alias("chat"))
    kind = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
    read = verify.vectorised(verify.marked_chat, kind, "chat")
    return rows.select("candidate_id", "stored", F.size(read).alias("parsed"))


@query("""SELECT o_orderkey, o_orderkey%1000 AS answer FROM orders""")
def t35_boxed_answers(spark, d):
    """Reasoning and boxed answer parted at the last balanced box."""
    text = F.concat(F.lit("Step \\boxed{0} first. So it is \\boxed{"), (F.col("o_orderkey") % 1000).cast("string"), F.lit("}."))
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", F.get(verify.vectorised(verify.boxed, T.ArrayType(T.StringType()), "t"), F.lit(1)).cast("long").alias("answer"))


@query(f"""WITH s AS (SELECT candidate_id, pos, trim(regexp_replace(t,'(?s)^\\s*<think>.*?</think>',''),' ') AS c FROM {_ANSWERS}) SELECT score, count(*) AS answers, count(*) FILTER (WHERE success) AS passed FROM (
 SELECT 'exact' AS score, c='42' AS success FROM s UNION ALL SELECT 'contains_any', contains(lower(c),'tower') OR contains(lower(c),'river') FROM s UNION ALL SELECT 'contains_all', contains(lower(c),'tower') AND contains(lower(c),'river') FROM s
 UNION ALL SELECT 'three_bullets', (SELECT count(*)=3 AND bool_and(starts_with(x,'- ')) FROM (SELECT unnest(string_split(c,chr(10))) AS x) WHERE trim(x,' ')<>'') FROM s UNION ALL SELECT 'formula', lower(replace(replace(c,'₂','2'),' ',''))='h2o' FROM s
 UNION ALL SELECT 'python_function', contains(regexp_replace(c,'\\s+',' ','g'),'def ') AND regexp_matches(c,'return\\s+') FROM s UNION ALL SELECT 'short_pair', contains(c,'炉灶') AND contains(c,'窑炉') AND length(c)<=50 FROM s UNION ALL SELECT 'json', coalesce(json_valid(c) AND starts_with(c,'{{'),false) FROM s) GROUP BY score""")
def c13_score_types(spark, d):
    """All eight kinds of chat scores over every answer: how many pass each."""
    t = F.trim(X.strip_thinking(F.col("t")))
    kinds = {
        "exact": S.exact(t, "42"), "contains_any": S.contains_any(t, ("tower", "river")), "contains_all": S.contains_all(t, ("tower", "river")), "three_bullets": S.bullets(t, 3), "formula": S.formula(t, "h2o"),
        "python_function": S.python_function(t, "def ", r"return\s+"), "short_pair": S.short_with(t, ("炉灶", "窑炉"), 50), "json": F.try_parse_json(t).isNotNull() & F.startswith(t, F.lit("{")),
    }
    rows = _answers(spark, d).select(F.explode(F.array(*(F.struct(F.lit(k).alias("score"), F.coalesce(v, F.lit(False)).alias("success")) for k, v in kinds.items()))).alias("x"))
    return rows.groupBy("x.score").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("x.success")).alias("passed"))


_TASK = "SELECT range AS n, range%97 AS a, (range*31)%89 AS b, range%{k} AS f FROM range(0,5000)"


@query("""SELECT n AS task_id, ['add','subtract','multiply','mod10','larger','difference','upper','reverse','count','last'][f+1] AS family, CASE f WHEN 0 THEN 'What is '||a||' plus '||b||'?' WHEN 1 THEN 'What is '||a||' minus '||b||'?' WHEN 2 THEN 'What is '||a||' times '||b||'?' WHEN 3 THEN 'What is the last digit of '||a||' times '||b||'?' WHEN 4 THEN 'Which is larger, '||a||' or '||b||'?'
 WHEN 5 THEN 'How far apart are '||a||' and '||b||'?' WHEN 6 THEN 'Write word'||a||' in capitals.' WHEN 7 THEN 'Write '||(100+a)||' backwards.' WHEN 8 THEN 'How many digits has '||(a*b*b)||'?' ELSE 'Reply with the last word: '||a||' then '||b||'.' END AS prompt,
 CASE f WHEN 0 THEN (a+b)::VARCHAR WHEN 1 THEN (a-b)::VARCHAR WHEN 2 THEN (a*b)::VARCHAR WHEN 3 THEN (a*b%10)::VARCHAR WHEN 4 THEN greatest(a,b)::VARCHAR WHEN 5 THEN abs(a-b)::VARCHAR WHEN 6 THEN 'WORD'||a WHEN 7 THEN reverse((100+a)::VARCHAR) WHEN 8 THEN length((a*b*b)::VARCHAR)::VARCHAR ELSE b::VARCHAR END AS answer,
 CASE WHEN ('0x'||substr(sha256('split|'||n),1,8))::BIGINT%100<5 THEN 'validation' ELSE 'train' END AS split FROM (""" + _TASK.format(k=10) + ")")
def t38_task_families(spark, d):
    """Ten families of generated tasks with their answers; splits by hash."""
    return S.generated_tasks(spark, 5000)


@query("""SELECT item_id, concat_ws(' ', trim(task), '{"config":'||coalesce('"'||config||'"','null')||',"line":'||source_line_number||'}', trim(split)) AS query_text FROM eval_reference""")
def t39_query_fields(spark, d):
    """Fields joined by blanks, records as JSON, missing ones left out."""
    record = F.to_json(F.struct(F.col("config").alias("config"), F.col("source_line_number").alias("line")), {"ignoreNullFields": "false"})
    return table(spark, d, "eval_reference").select("item_id", F.concat_ws(" ", F.trim("task"), record, F.trim("split")).alias("query_text"))


@query("""WITH c AS (SELECT event_type AS scenario, user_id%4 AS arm, count(*) AS n, median(value) AS mid FROM events GROUP BY ALL), g AS (SELECT s.scenario, a.range AS arm FROM (SELECT DISTINCT scenario FROM c) s CROSS JOIN range(0,4) a)
 SELECT g.scenario, g.arm::INT AS arm, coalesce(c.n,0) AS n, coalesce(c.n,0)>=20 AS enough, b.mid/c.mid AS speed_up FROM g LEFT JOIN c ON c.scenario=g.scenario AND c.arm=g.arm LEFT JOIN c b ON b.scenario=g.scenario AND b.arm=0""")
def a34_scenario_grid(spark, d):
    """Every scenario and arm of the expected grid: repeats, whether there are 20, and the speed-up over arm 0."""
    e = table(spark, d, "events").select(F.col("event_type").alias("scenario"), (F.col("user_id") % 4).cast("int").alias("arm"), "value")
    cells = e.groupBy("scenario", "arm").agg(F.count(F.lit(1)).alias("n")).join(exact_quantiles(e, ["scenario", "arm"], "value", {"mid": ("cont", 0.5)}), ["scenario", "arm"], "left")
    grid = e.select("scenario").distinct().crossJoin(spark.range(4).select(F.col("id").cast("int").alias("arm")))
    base = cells.filter("arm = 0").select("scenario", F.col("mid").alias("base"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(cells, ["scenario", "arm"], "left").join(base, "scenario", "left").select("scenario", "arm", n.alias("n"), (n >= 20).alias("enough"), (F.col("base") / F.col("mid")).alias("speed_up"))


@query("""WITH m AS (SELECT user_id AS task, avg((value>2)::INT) FILTER (WHERE event_type='purchase') AS acc_norm, avg((value>2)::INT) FILTER (WHERE event_type='click') AS acc FROM events GROUP BY user_id) SELECT task, 100*coalesce(acc_norm, acc) AS percent, acc_norm IS NULL AS fallback, avg(100*coalesce(acc_norm, acc)) OVER () AS macro FROM m WHERE coalesce(acc_norm, acc) IS NOT NULL""")
def a36_normalised_or_plain(spark, d):
    """The normalised accuracy of each task, or the plain one where there is none, in percent, and their mean."""
    on = lambda kind: F.avg(F.when(F.col("event_type") == kind, (F.col("value") > 2).cast("int")))
    m = table(spark, d, "events").groupBy(F.col("user_id").alias("task")).agg(on("purchase").alias("norm"), on("click").alias("acc"))
    rows = m.select("task", (100 * F.coalesce("norm", "acc")).alias("percent"), F.col("norm").isNull().alias("fallback")).filter("percent is not null")
    return rows.crossJoin(rows.agg(F.avg("percent").alias("macro")))


@query("""WITH w AS (SELECT source, text, list_filter(regexp_split_to_array(coalesce(text,''),'\\s+'), lambda x: x<>'') AS w FROM documents) SELECT source, count(*) FILTER (WHERE len(w)>0) AS filled, count(*) FILTER (WHERE len(w)=0) AS immediate_empty, avg(len(w)) FILTER (WHERE len(w)>0) AS mean_tokens, coalesce(sum(len(list_distinct(w))),0)::BIGINT AS unique_ids, count(DISTINCT text) AS unique_texts FROM w GROUP BY source""")
def a37_continuation_tokens(spark, d):
    """Continuations per source: filled, empty at once, mean tokens, distinct tokens in each and distinct texts (by digest)."""
    w = X.words(F.coalesce("text", F.lit("")))
    n = F.size(w)
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(n > 0).alias("filled"), F.count_if(n == 0).alias("immediate_empty"), F.avg(F.when(n > 0, n)).alias("mean_tokens"), F.sum(F.size(F.array_distinct(w))).alias("unique_ids"), F.countDistinct(F.sha2("text", 256)).alias("unique_texts"))


@query("""WITH l AS (SELECT [ '', task, task||'/'||source_id, task||'/'||source_id||'/'||coalesce(config,'-') ] AS path, length(normalized_prompt) AS v FROM eval_reference), leaf AS (SELECT path[4] AS leaf, path, count(*) AS n, avg(v) AS m FROM l GROUP BY ALL), u AS (SELECT leaf, unnest(path) AS node, unnest(range(0,4)) AS depth, n, m FROM leaf)
 SELECT node, depth::INT AS depth, count(*) AS leaves, sum(n)::BIGINT AS n_items, sum(m*n)/sum(n) AS weighted, avg(m) AS macro FROM u GROUP BY node, depth""")
def a23_tree_scores(spark, d):
    """Weighted and plain means of the leaves below every node of a task tree of any depth: a leaf is counted at each of its ancestors."""
    leaf = table(spark, d, "eval_reference").groupBy("task", "source_id", F.coalesce("config", F.lit("-")).alias("config")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("normalized_prompt")).alias("m"))
    parts = F.array("task", "source_id", "config")
    nodes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return leaf.select(F.posexplode(nodes).alias("depth", "node"), "n", "m").groupBy("node", "depth").agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("n_items"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("weighted"), F.avg("m").alias("macro"))


@query(f"""WITH a AS (SELECT candidate_id, max(pos) FILTER (WHERE role='assistant') AS last, sum(length(coalesce(content,''))) AS chars, sum(len(list_filter(regexp_split_to_array(coalesce(content,''),'\\s+'), lambda w: w<>''))) AS words, count(*) FILTER (WHERE role='assistant') AS heads FROM {_ONE} GROUP BY candidate_id),
 r AS (SELECT candidate_id, CASE WHEN heads=0 THEN 'no_answer' WHEN chars>3000 THEN 'long' END AS x, CASE WHEN heads=0 THEN 'no_answer' WHEN words>300 THEN 'long' WHEN words<10 THEN 'short' END AS y FROM a), b AS (SELECT DISTINCT candidate_id, bucket FROM candidates),
 k AS (SELECT r.*, b.bucket, row_number() OVER (PARTITION BY b.bucket, x IS NULL AND y IS NULL ORDER BY sha256('arm|'||candidate_id)) AS place FROM r JOIN b USING (candidate_id)) SELECT candidate_id, bucket, CASE WHEN x IS NOT NULL OR y IS NOT NULL THEN coalesce('first: '||x, 'second: '||y) WHEN place<=100 THEN 'accepted' ELSE 'over_cap' END AS state FROM k""")
def c9_symmetric_arms(spark, d):
    """The same records in both arms: one goes if either arm's rule drops it, and at most 100 of a kind stay, by hash."""
    conv = F.col("conv")
    total = lambda f: F.aggregate(F.transform(conv, lambda m: f(F.coalesce(m["content"], F.lit("")))), F.lit(0), lambda a, x: a + x)
    heads = F.size(F.filter(conv, lambda m: m["role"] == "assistant"))
    chars, words = total(F.length), total(X.word_count)
    first = F.when(heads == 0, "no_answer").when(chars > 3000, "long")
    second = F.when(heads == 0, "no_answer").when(words > 300, "long").when(words < 10, "short")
    rows = _conv(spark, d).select("candidate_id", "bucket", first.alias("x"), second.alias("y"), X.hash_order("arm", F.col("candidate_id")).alias("h"))
    good = rows.filter("x is null and y is null")
    kept = budget.bottom_k(good, 100, ["bucket"], F.col("h")).select("candidate_id", F.lit(True).alias("kept"))
    state = F.when(F.col("x").isNotNull(), F.concat(F.lit("first: "), "x")).when(F.col("y").isNotNull(), F.concat(F.lit("second: "), "y")).when(F.col("kept"), "accepted").otherwise("over_cap")
    return rows.join(kept, "candidate_id", "left").select("candidate_id", "bucket", state.alias("state"))


_ENV = "(SELECT o_orderkey AS id, ['plain','redirect','retry','branch'][o_orderkey%4+1] AS family, o_orderkey%50 AS a, o_orderkey%7 AS b, CASE WHEN o_orderkey%3=0 THEN 'subtract' ELSE 'add' END AS op FROM orders)"


@query(f"""SELECT id, family, CASE family WHEN 'redirect' THEN 'root>'||a||' alias>moved leaf>'||b WHEN 'retry' THEN 'root>'||a||' leaf>temporary_error leaf>'||b ELSE 'root>'||a||' leaf>'||b END||' '||op||'>'||CASE op WHEN 'add' THEN a+b ELSE a-b END AS trace, CASE family WHEN 'redirect' THEN 4 WHEN 'retry' THEN 4 ELSE 3 END AS calls, CASE op WHEN 'add' THEN a+b ELSE a-b END AS answer FROM {_ENV}""")
def c11_tool_walks(spark, d):
    """Expected calls of every task in the record environment and what they return: plain, redirected, retried and branched walks."""
    k = F.col("o_orderkey")
    family = F.element_at(F.array(*map(F.lit, ("plain", "redirect", "retry", "branch"))), (k % 4 + 1).cast("int"))
    tasks = table(spark, d, "orders").select(k.alias("id"), family.alias("family"), (k % 50).alias("a"), (k % 7).alias("b"), F.when(k % 3 == 0, "subtract").otherwise("add").alias("op"))
    return S.tool_walks(tasks)


_CALLS = f"""m AS (SELECT candidate_id, pos, role, content, CASE WHEN json_valid(tool_calls) THEN json_array_length(tool_calls) ELSE 0 END AS n FROM {_ONE}), g AS (SELECT candidate_id, list(CASE WHEN role='tool' AND json_valid(content) THEN json_extract_string(CASE WHEN json_valid(content) THEN content END,'$.result') END) FILTER (WHERE CASE WHEN role='tool' AND json_valid(content) THEN json_extract_string(CASE WHEN json_valid(content) THEN content END,'$.result') END IS NOT NULL) AS gt, coalesce(sum(n) FILTER (WHERE role='assistant'),0) AS calls, arg_max(coalesce(content,''), pos) FILTER (WHERE role='assistant') AS final FROM m GROUP BY candidate_id HAVING count(*) FILTER (WHERE role='assistant')>0)"""


@query(f"""WITH {_CALLS}, w AS (SELECT *, regexp_extract_all(lower(final),'([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\p{{Z}}\\s])',1) AS t FROM g), p AS (SELECT *, list_transform(range(1, len(t)-1), lambda i: array_to_string(t[i:i+2],' ')) AS q FROM w),
 r AS (SELECT candidate_id, calls, CASE WHEN len(q)>0 THEN least(0.5,(len(q)-len(list_distinct(q)))*0.5*2/len(q)) ELSE 0 END AS penalty, coalesce(len(gt),0) AS want, CASE WHEN coalesce(len(gt),0)=0 THEN 0 ELSE len(list_filter(gt, lambda x: contains(lower(final), lower(x))))*2.5/len(gt) END AS covered, length(trim(final,' ')) AS chars FROM p)
 SELECT candidate_id, greatest(-3.0, least(3.0, CASE WHEN calls=0 THEN CASE WHEN chars BETWEEN 5 AND 800 THEN 0.5 ELSE -0.5 END ELSE CASE WHEN calls=want THEN 0.5 ELSE -0.5*abs(calls-want) END + covered END - penalty))::DOUBLE AS reward FROM r""")
def c12_conversation_reward(spark, d):
    """Length for plain answers; agreement of calls with what tools returned and how much of it the last answer says, for the rest; less repetition, within 3."""
    conv = F.col("conv")
    tool = F.filter(F.transform(F.filter(conv, lambda m: m["role"] == "tool"), lambda m: F.get_json_object(m["content"], "$.result")), lambda x: x.isNotNull())
    heads = F.filter(conv, lambda m: m["role"] == "assistant")
    calls = F.aggregate(F.transform(heads, lambda m: F.coalesce(F.json_array_length(m["tool_calls"]), F.lit(0))), F.lit(0), lambda a, x: a + x)
    rows = _conv(spark, d).filter(F.size(heads) > 0).select("candidate_id", tool.alias("gt"), calls.alias("calls"), F.coalesce(F.element_at(heads, -1)["content"], F.lit("")).alias("final"))
    return rows.select("candidate_id", S.conversation_reward(F.col("final"), F.col("calls"), F.col("gt")).alias("reward"))


_NEED = "'(?:(at least|at most|exactly|no more than|fewer than|more than) )?([0-9]+|two|three|four|five|six|seven|eight|nine|ten) (word|sentence|paragraph|bullet|step|use|line|reason)s?'"


@query(f"""SELECT candidate_id, kind, CASE how WHEN 'at most' THEN NULL WHEN 'no more than' THEN NULL WHEN 'fewer than' THEN NULL WHEN 'more than' THEN n+1 ELSE n END::INT AS low, CASE how WHEN 'at least' THEN NULL WHEN 'more than' THEN NULL WHEN 'fewer than' THEN n-1 ELSE n END::INT AS high
 FROM (SELECT candidate_id, unnest(regexp_extract_all(p,{_NEED},1)) AS how, unnest(list_transform(regexp_extract_all(p,{_NEED},2), lambda x: coalesce(list_position(['two','three','four','five','six','seven','eight','nine','ten'], x)+1, try_cast(x AS INT)))) AS n, unnest(regexp_extract_all(p,{_NEED},3)) AS kind FROM (SELECT DISTINCT candidate_id, prompt_norm AS p FROM candidates))""")
def t24_all_requirements(spark, d):
    """Every counted requirement of a prompt, not only its first: kind and bounds, open sides null."""
    words = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
    pattern = F.lit(r"(?:(at least|at most|exactly|no more than|fewer than|more than) )?([0-9]+|two|three|four|five|six|seven|eight|nine|ten) (word|sentence|paragraph|bullet|step|use|line|reason)s?")
    parts = F.arrays_zip(*(F.regexp_extract_all("prompt_norm", pattern, F.lit(k)).alias(name) for k, name in ((1, "how"), (2, "n"), (3, "kind"))))
    rows = table(spark, d, "candidates").select("candidate_id", "prompt_norm").distinct().select("candidate_id", F.explode(parts).alias("r"))
    at = F.array_position(F.array(*map(F.lit, words)), F.col("r.n"))
    n, how = F.when(at > 0, at + 1).otherwise(F.col("r.n").try_cast("long")).cast("int"), F.col("r.how")
    low = F.when(how.isin("at most", "no more than", "fewer than"), None).when(how == "more than", n + 1).otherwise(n)
    high = F.when(how.isin("at least", "more than"), None).when(how == "fewer than", n - 1).otherwise(n)
    return rows.select("candidate_id", F.col("r.kind").alias("kind"), low.cast("int").alias("low"), high.cast("int").alias("high"))


@query("""SELECT DISTINCT candidate_id, prompt_norm AS prompt FROM candidates""")
def c3_normalised_prompts(spark, d):
    """User contents joined by newlines, NFKC, case-folded, blank runs one space: made anew from the conversations."""
    rows = _conv(spark, d).select("candidate_id", C.user_prompt(F.col("conv")).alias("p"))
    return rows.select("candidate_id", verify.vectorised(spaced, T.StringType(), "p").alias("prompt"))


@query("""SELECT record_id, (place//64)::BIGINT AS batch, (place%64)::BIGINT AS place_in_batch FROM (SELECT record_id, row_number() OVER (ORDER BY sha256('epoch 1|'||record_id), record_id)-1 AS place FROM (SELECT DISTINCT record_id FROM raw_pairs)) WHERE place//64>=3""")
def o23_skip_batches(spark, d):
    """An epoch's batches in hash order, from the batch at which a run is resumed."""
    rows = budget.ranked(table(spark, d, "raw_pairs").select("record_id").distinct(), "place", X.hash_order("epoch 1", F.col("record_id")), F.col("record_id"))
    return rows.select("record_id", F.expr("place div 64").alias("batch"), (F.col("place") % 64).alias("place_in_batch")).filter("batch >= 3")


_ROUTES = "(VALUES ('code','code','plain','strip'),('math','math','steps','number'),('web','general','plain','none'),('letters','chinese','dialog','none'),('lab','reports','plain','none')) r(head, bucket, variant, transform)"


@query(f"""SELECT doc_id, coalesce(r.bucket,'general') AS bucket, coalesce(r.variant,'plain')||CASE WHEN lower(trim(coalesce(lang,'')))='zh' THEN ':zh' ELSE '' END AS variant, CASE coalesce(r.transform,'none') WHEN 'strip' THEN length(replace(text,'```','')) WHEN 'number' THEN len(regexp_extract_all(text,'[0-9]+')) ELSE length(text) END::BIGINT AS measure FROM documents LEFT JOIN {_ROUTES} ON r.head=regexp_extract(lower(replace(coalesce(source,''),'-','_')),'^([a-z]+)',1)""")
def f11_routing_table(spark, d):
    """Documents joined to a table of routes by the head of their source: bucket, variant and what is done to the text."""
    routes = spark.createDataFrame([("code", "code", "plain", "strip"), ("math", "math", "steps", "number"), ("web", "general", "plain", "none"), ("letters", "chinese", "dialog", "none"), ("lab", "reports", "plain", "none")], "head string, bucket string, variant string, transform string")
    head = F.regexp_extract(F.lower(F.replace(F.coalesce("source", F.lit("")), F.lit("-"), F.lit("_"))), "^([a-z]+)", 1)
    rows = table(spark, d, "documents").select("doc_id", "lang", "text", head.alias("head")).join(routes, "head", "left")
    text = F.col("text")
    measure = F.when(F.col("transform") == "strip", F.length(F.replace(text, F.lit("```"), F.lit("")))).when(F.col("transform") == "number", F.size(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)))).otherwise(F.length(text))
    variant = F.concat(F.coalesce("variant", F.lit("plain")), F.when(F.lower(F.trim(F.coalesce("lang", F.lit("")))) == "zh", ":zh").otherwise(""))
    return rows.select("doc_id", F.coalesce("bucket", F.lit("general")).alias("bucket"), variant.alias("variant"), measure.cast("long").alias("measure"))


_GRAMS = "list_distinct(list_transform(range(1, length(t)-3), lambda i: substr(t,i,5)))"


@query(f"""WITH RECURSIVE t AS (SELECT min(candidate_id) AS id, prompt_norm AS t FROM candidates WHERE prompt_norm IS NOT NULL GROUP BY prompt_norm), g AS (SELECT id, {_GRAMS} AS g FROM t), u AS (SELECT id, len(g) AS n, unnest(g) AS x FROM g), p AS (SELECT a.id AS i, b.id AS j FROM u a JOIN u b ON a.x=b.x AND a.id<b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*)>=0.8*(a.n+b.n-count(*))),
 e AS (SELECT i AS a, j AS b FROM p UNION SELECT j, i FROM p), r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y=e.a) SELECT x AS id, least(x, min(y)) AS component FROM r GROUP BY x""")
def d11_near_components(spark, d):
    """Connected components of nearly equal prompts."""
    pairs = contamination.gram_pairs(table(spark, d, "candidates"), "candidate_id", "prompt_norm")
    return dedup.components(pairs, "id_a", "id_b")
