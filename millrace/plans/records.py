"""Nested records, source shapes, message checks, preference pairs, replay mixtures and sidecar audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import verify
from ..operators import budget, setjoin, shapes
from ..operators import conversation as C
from ..runtime import table, written
from .conversations import _ONE, _conv
from .registry import query

_P = "(SELECT DISTINCT candidate_id, provenance_json AS p FROM candidates)"


def _provenance(spark, d):
    return table(spark, d, "candidates").select("candidate_id", F.col("provenance_json").alias("p")).distinct()


@query(f"SELECT candidate_id, json_extract_string(p,'$.source_record_locator.line_number') AS value, coalesce(json_exists(p,'$.source_record_locator.line_number'),false) AS present, coalesce(json_exists(p,'$.source_record_locator.page'),false) AS page_present FROM {_P}")
def f2_nested_lookup(spark, d):
    at, page = (shapes.nested(F.col("p"), f"source_record_locator.{k}") for k in ("line_number", "page"))
    return _provenance(spark, d).select("candidate_id", at["value"].alias("value"), at["present"].alias("present"), page["present"].alias("page_present"))


@query(f"""SELECT candidate_id, CASE WHEN json_exists(p,'$.source_record_locator.row') THEN json_extract_string(p,'$.source_record_locator.row') WHEN json_exists(p,'$.row') THEN json_extract_string(p,'$.row') WHEN json_exists(p,'$.source_record_locator.line_number') THEN json_extract_string(p,'$.source_record_locator.line_number')
 WHEN json_exists(p,'$.line_number') THEN json_extract_string(p,'$.line_number') END AS value, coalesce(json_exists(p,'$.source_record_locator.line_number'),false) AS present FROM {_P}""")
def f3_first_present(spark, d):
    """The row number under any of its names, in the locator first and then in the record."""
    found = shapes.first_present([F.get_json_object("p", "$.source_record_locator"), F.col("p")], ("row", "line_number"))
    return _provenance(spark, d).select("candidate_id", found["value"].alias("value"), found["present"].alias("present"))


@query("""SELECT doc_id, CASE lower(trim(coalesce(lang,''))) WHEN 'c++' THEN 'cpp' WHEN 'c#' THEN 'csharp' ELSE lower(trim(coalesce(lang,''))) END AS lang_name FROM documents""")
def f4_language_names(spark, d):
    """Languages as text and as records of three shapes, the same names from all."""
    lang, k = F.col("lang"), F.col("doc_id") % 4
    stored = F.when(k == 0, F.to_json(F.struct(lang.alias("name")))).when(k == 1, F.to_json(F.struct(F.lit("").alias("name"), lang.alias("language")))).when(k == 2, F.to_json(F.struct(lang.alias("id")))).otherwise(lang)
    return table(spark, d, "documents").select("doc_id", shapes.language_value(stored).alias("lang_name"))


@query("""SELECT source_id, CASE WHEN license IS NULL THEN repo_id||'|x' ELSE trim(license)||'|'||repo_id||'|x' END AS licenses FROM sources""")
def f5_nested_licenses(spark, d):
    """Licences in JSON in text, lists, records under several keys and parted names."""
    stored = F.to_json(F.struct(F.array("license").alias("declared"), F.struct(F.concat("repo_id", F.lit("; x,")).alias("name")).alias("extra")))
    names = verify.vectorised(shapes.license_names, shapes.LICENSES, "stored")
    return table(spark, d, "sources").withColumn("stored", stored).select("source_id", F.array_join(names, "|").alias("licenses"))


@query("""SELECT event_id, lower(trim(v)) IN ('1','true','yes','y','vendor') AS vendored FROM (SELECT event_id, CASE event_id%6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'VENDOR' WHEN 2 THEN 'false' WHEN 3 THEN '1' WHEN 4 THEN '' END AS v FROM events)""")
def f6_vendor_flags(spark, d):
    k = F.col("event_id") % 6
    stored = F.when(k == 0, " Yes ").when(k == 1, "VENDOR").when(k == 2, "false").when(k == 3, "1").when(k == 4, "")
    return table(spark, d, "events").select("event_id", X.truthy(stored).alias("vendored"))


@query(r"""SELECT DISTINCT candidate_id, line_number, coalesce(list_has_any(regexp_split_to_array(lower(p),'[\\/]+'), ['node_modules','third_party','third-party','vendor','vendors']), false) AS vendored
 FROM (SELECT candidate_id, line_number, CASE line_number%5 WHEN 0 THEN 'lib\Third-Party\'||source_path WHEN 1 THEN 'Vendors//'||source_path ELSE source_path END AS p FROM pretrain_records)""")
def f7_vendor_paths(spark, d):
    k, path = F.col("line_number") % 5, F.col("source_path")
    stored = F.when(k == 0, F.concat(F.lit("lib\\Third-Party\\"), path)).when(k == 1, F.concat(F.lit("Vendors//"), path)).otherwise(path)
    return table(spark, d, "pretrain_records").select("candidate_id", "line_number", shapes.in_vendor_path(stored).alias("vendored")).distinct()


@query(f"SELECT candidate_id, pos::INT AS item_index, content AS text FROM {_ONE} WHERE role<>'system' AND content IS NOT NULL AND content<>''")
def f9_nested_items(spark, d):
    """The nested records of a row as rows of their own, those that pass with their place in the row."""
    keep = lambda m: (m["role"] != "system") & (F.coalesce(m["content"], F.lit("")) != "")
    return shapes.exploded(_conv(spark, d), "candidate_id", F.col("conv"), keep, lambda m: m["content"])


_RAW = r"""(SELECT DISTINCT record_id, coalesce(source_id,'') AS extra, trim(regexp_replace(split_part(text,chr(10),1),'^[^:：]{1,20}[:：]',''),' ') AS q, trim(regexp_replace(CASE WHEN contains(text,chr(10)) THEN substr(text, strpos(text,chr(10))+1) ELSE '' END,'^[^:：\n]{1,20}[:：]',''),' ') AS a FROM raw_pairs WHERE text IS NOT NULL)"""


@query(rf"""SELECT record_id, CASE record_id%8 WHEN 7 THEN 'Summarize the following news article faithfully and concisely.'||chr(10)||chr(10)||'Article:'||chr(10)||q WHEN 2 THEN q WHEN 3 THEN q ELSE
 q || CASE WHEN trim(extra,' ')='' THEN '' ELSE chr(10)||chr(10)||CASE WHEN record_id%8 IN (0,1) THEN '输入：' WHEN record_id%8=4 THEN 'Input:' WHEN record_id%8=5 THEN 'Your solution must pass these tests:' ELSE 'Context:' END||chr(10)||trim(extra,' ') END END AS prompt, a AS answer FROM {_RAW}""")
def f10_source_adapter(spark, d):
    """Raw pairs taken through all eight source shapes to one form of conversation."""
    text, names = F.col("text"), list(shapes.ADAPTERS)
    first = F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), r"^[^:：]{1,20}[:：]", "")
    rest = F.when(F.contains(text, F.lit("\n")), F.substring(text, F.locate("\n", text) + 1, F.length(text))).otherwise("")
    rows = table(spark, d, "raw_pairs").filter("text is not null").select("record_id", F.coalesce("source_id", F.lit("")).alias("extra"), F.trim(first).alias("q"), F.trim(F.regexp_replace(rest, r"^[^:：\n]{1,20}[:：]", "")).alias("a")).distinct()
    conv = None
    for k, name in enumerate(names):
        instruction, more, _, answer, _ = shapes.ADAPTERS[name]
        columns = {instruction: F.col("q"), more: F.col("extra"), answer: F.col("a")}
        shaped = shapes.adapted(name, columns.__getitem__)
        conv = F.when(F.col("record_id") % 8 == k, shaped) if conv is None else conv.when(F.col("record_id") % 8 == k, shaped)
    return rows.select("record_id", conv.alias("c")).select("record_id", F.col("c")[0]["content"].alias("prompt"), F.col("c")[1]["content"].alias("answer"))


_TWO = f"(SELECT candidate_id, max(content) FILTER (WHERE pos=0) AS prompt, max(content) FILTER (WHERE pos=1) AS answer FROM {_ONE} GROUP BY candidate_id HAVING count(*)=2 AND count(*) FILTER (WHERE pos=0 AND role='user')=1 AND count(*) FILTER (WHERE pos=1 AND role='assistant')=1)"
_REPLAY = f"(SELECT DISTINCT 'replay-'||substr(sha256(prompt||chr(0)||answer),1,20) AS task_id, prompt, answer FROM {_TWO} WHERE prompt<>'' AND answer<>'' AND length(prompt)<=360 AND length(answer)<=240)"


def _replay(spark, d):
    conv = F.col("conv")
    prompt, answer = F.element_at(conv, 1)["content"], F.element_at(conv, 2)["content"]
    rows = _conv(spark, d).filter((F.size(conv) == 2) & (F.get(conv, F.lit(0))["role"] == "user") & (F.get(conv, F.lit(1))["role"] == "assistant")).select(prompt.alias("prompt"), answer.alias("answer"))
    rows = rows.filter("prompt <> '' and answer <> '' and length(prompt) <= 360 and length(answer) <= 240")
    return rows.select(F.concat(F.lit("replay-"), F.substring(F.sha2(F.concat("prompt", F.lit("\0"), "answer"), 256), 1, 20)).alias("task_id"), "prompt", "answer").distinct()


@query(f"SELECT task_id, prompt, answer FROM {_REPLAY}")
def f16_replay_filter(spark, d):
    """Two-message conversations short enough to be replayed, each under a name from its content."""
    return _replay(spark, d)


@query(f"""SELECT kind, task_id, (row_number() OVER (ORDER BY sha256('42|'||task_id), task_id)-1)::BIGINT AS place FROM (SELECT 'replay' AS kind, task_id FROM {_REPLAY} UNION ALL SELECT 'task', 'task-'||item_id FROM eval_reference)""")
def o18_mixture_with_replay(spark, d):
    """New tasks and replayed ones in one new order."""
    tasks = table(spark, d, "eval_reference").select(F.lit("task").alias("kind"), F.concat(F.lit("task-"), F.col("item_id").cast("string")).alias("task_id"))
    rows = _replay(spark, d).select(F.lit("replay").alias("kind"), "task_id").unionByName(tasks)
    return budget.ranked(rows, "place", X.hash_order("42", F.col("task_id")), F.col("task_id")).select("kind", "task_id", "place")


@query("""SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey)-1)::BIGINT AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('o25|'||o_orderkey::VARCHAR)) AS k FROM orders) WHERE k<=1000""")
def o25_sample_in_source_order(spark, d):
    """1,000 rows without replacement by hash, in the order they had."""
    rows = table(spark, d, "orders").select("o_orderkey").withColumn("h", X.hash_order("o25", F.col("o_orderkey"))).orderBy("h").limit(1000)
    return budget.ranked(rows.select("o_orderkey"), "place", F.col("o_orderkey")).select("o_orderkey", "place")


@query("""SELECT p.shard, p.line_number, p.candidate_id, p.content_sha256 FROM (SELECT DISTINCT shard, line_number, candidate_id, content_sha256 FROM pretrain_records) p SEMI JOIN (SELECT first_shard, first_line FROM validation_chunks) c ON p.shard=c.first_shard AND p.line_number=c.first_line""")
def s10_rows_by_place(spark, d):
    """Random access: the rows at given places, by a semi join that reads four columns."""
    want = table(spark, d, "validation_chunks").select(F.col("first_shard").alias("shard"), F.col("first_line").alias("line_number"))
    return table(spark, d, "pretrain_records").select("shard", "line_number", "candidate_id", "content_sha256").distinct().join(want, ["shard", "line_number"], "left_semi")


_MESSAGES = "(SELECT candidate_id, pos, lower(trim(m->>'role')) AS role, m->>'content' AS content, m->>'reasoning_content' AS reasoning, m->>'tools' AS tools, m->>'tool_calls' AS calls FROM (SELECT *, unnest(CAST(json_extract(payload_json,'$.conversations[*]') AS JSON[])) AS m, generate_subscripts(json_extract(payload_json,'$.conversations[*]'),1)-1 AS pos FROM (SELECT candidate_id, payload_json FROM candidates QUALIFY ingested_at = min(ingested_at) OVER (PARTITION BY candidate_id))))"
_B = lambda c: f"(trim(coalesce({c},''),' ')='')"
_L = lambda c: f"({_B(c)} OR coalesce(CASE WHEN json_valid({c}) THEN json_array_length({c}) END,0)>0)"


@query(f"""SELECT coalesce(reason,'canonical') AS reason, role, count(*) AS messages FROM (SELECT role, CASE WHEN role IS NULL OR role NOT IN ('system','user','assistant','tool') THEN 'role' WHEN NOT {_L('tools')} THEN 'tools_json' WHEN NOT {_L('calls')} THEN 'tool_calls_json' WHEN NOT {_B('tools')} AND role<>'system' THEN 'tools_role'
 WHEN NOT {_B('calls')} AND role<>'assistant' THEN 'tool_calls_role' WHEN NOT {_B('reasoning')} AND role<>'assistant' THEN 'reasoning_role' WHEN role<>'assistant' AND {_B('content')} THEN 'empty' WHEN role='assistant' AND {_B('content')} AND {_B('reasoning')} AND {_B('calls')} THEN 'unsupervised' END AS reason FROM {_MESSAGES}) GROUP BY ALL""")
def c1_canonical_messages(spark, d):
    """Every message against the rules of canonical messages, after roles are mapped and texts trimmed."""
    rows = _conv(spark, d).select(F.explode(F.arrays_zip(F.col("conv").alias("raw"), C.canonical(F.col("conv")).alias("m"))).alias("z"))
    m = F.col("z.m")
    return rows.groupBy(F.coalesce(C.message_fault(m), F.lit("canonical")).alias("reason"), F.lower(F.trim(m["role"])).alias("role")).agg(F.count(F.lit(1)).alias("messages"))


@query(f"""WITH m AS (SELECT *, coalesce(CASE WHEN json_valid(calls) THEN json_array_length(calls) END,0)::INT AS n FROM {_MESSAGES}),
 b AS (SELECT *, min(CASE WHEN role='system' AND pos=0 THEN 1 ELSE 0 END) OVER w AS x, max(CASE WHEN pos=0 AND role='system' AND coalesce(CASE WHEN json_valid(tools) THEN json_array_length(tools) END,0)>0 THEN 1 ELSE 0 END) OVER w AS has_tools FROM m WINDOW w AS (PARTITION BY candidate_id)),
 body AS (SELECT * FROM b WHERE NOT (role='system' AND pos=0)),
 t AS (SELECT *, sum((role='user')::INT) OVER (PARTITION BY candidate_id ORDER BY pos) AS turn, row_number() OVER (PARTITION BY candidate_id ORDER BY pos) AS k FROM body),
 s AS (SELECT *, coalesce(sum(n-(role='tool')::INT) OVER (PARTITION BY candidate_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS pending, sum(n-(role='tool')::INT) OVER (PARTITION BY candidate_id, turn) AS at_end, count(*) FILTER (WHERE role='assistant') OVER (PARTITION BY candidate_id, turn) AS heads, max(pos) OVER (PARTITION BY candidate_id, turn) AS last FROM t),
 f AS (SELECT candidate_id, pos*2 AS place, CASE WHEN role='assistant' AND pending>0 THEN 'open_call' WHEN role='assistant' AND n>0 AND has_tools=0 THEN 'no_tools' WHEN role='tool' AND pending<=0 THEN 'orphan_tool' END AS fault FROM s UNION ALL SELECT candidate_id, last*2+1, CASE WHEN heads=0 THEN 'no_assistant' WHEN at_end>0 THEN 'unclosed_call' END FROM s),
 w AS (SELECT candidate_id, arg_min(fault, place) FILTER (WHERE fault IS NOT NULL) AS fault FROM f GROUP BY candidate_id),
 h AS (SELECT candidate_id, count(*) FILTER (WHERE role='system')>0 AS inner_system, max(CASE WHEN k=1 THEN role END) AS first_role FROM t GROUP BY candidate_id)
 SELECT coalesce(CASE WHEN h.inner_system THEN 'system_position' WHEN h.first_role<>'user' THEN 'starts_without_user' ELSE w.fault END,'settled') AS fault, count(*) AS conversations FROM (SELECT DISTINCT candidate_id FROM m) c LEFT JOIN h USING (candidate_id) LEFT JOIN w USING (candidate_id) GROUP BY ALL""")
def c4_turn_faults(spark, d):
    """The tool-call state machine over every conversation: its first fault, or settled."""
    rows = _conv(spark, d).filter(F.size("conv") > 0)
    return rows.groupBy(F.coalesce(C.turn_fault(F.col("conv")), F.lit("settled")).alias("fault")).agg(F.count(F.lit(1)).alias("conversations"))


def _pairs(spark, d):
    """Preference pairs from records with equal prompts: the best and the worst by selection rank."""
    rows = _conv(spark, d).filter("prompt_norm is not null").select("candidate_id", "prompt_norm", "selection_rank")
    ends = rows.groupBy(F.sha2("prompt_norm", 256).alias("k")).agg(F.min(F.struct("selection_rank", "candidate_id"))["candidate_id"].alias("chosen_id"), F.max(F.struct("selection_rank", "candidate_id"))["candidate_id"].alias("rejected_id")).filter("chosen_id <> rejected_id")
    conv = _conv(spark, d).select("candidate_id", "conv")
    for side in ("chosen", "rejected"):
        ends = ends.join(conv.select(F.col("candidate_id").alias(f"{side}_id"), F.col("conv").alias(side)), f"{side}_id")
    return ends


_SQ = lambda c: f"lower(trim(regexp_replace(coalesce({c},''),'\\s+',' ','g'),' '))"
_SIDES = f"""conv AS (SELECT candidate_id, count(*) AS n, max(pos) AS last, string_agg(role||chr(1)||coalesce(content,''),chr(2) ORDER BY pos) FILTER (WHERE pos=0) AS ctx, max(content) FILTER (WHERE pos=0) AS q, arg_max(role,pos) AS role, arg_max(coalesce(content,''),pos) AS a FROM {_ONE} GROUP BY candidate_id),
 o AS (SELECT DISTINCT candidate_id, prompt_norm, selection_rank FROM candidates WHERE prompt_norm IS NOT NULL), e AS (SELECT prompt_norm, arg_min(candidate_id, selection_rank||'|'||candidate_id) AS chosen_id, arg_max(candidate_id, selection_rank||'|'||candidate_id) AS rejected_id FROM o GROUP BY prompt_norm HAVING count(DISTINCT candidate_id)>1),
 p AS (SELECT chosen_id, rejected_id, x.q, x.a AS good, y.a AS bad, CASE WHEN x.n<>2 OR y.n<>2 OR x.ctx<>y.ctx THEN 'context_mismatch' WHEN length({_SQ('x.q')})<12 THEN 'short_prompt' WHEN x.role<>'assistant' OR y.role<>'assistant' OR trim(x.a,' ')='' OR trim(y.a,' ')='' THEN 'schema' WHEN {_SQ('x.a')}={_SQ('y.a')} THEN 'identical_answers' END AS reason FROM e JOIN conv x ON x.candidate_id=chosen_id JOIN conv y ON y.candidate_id=rejected_id)"""


@query(f"WITH {_SIDES} SELECT chosen_id, rejected_id, coalesce(reason,'valid') AS reason FROM p")
def f17_pair_validity(spark, d):
    return _pairs(spark, d).select("chosen_id", "rejected_id", F.coalesce(shapes.pair_reason(F.col("chosen"), F.col("rejected")), F.lit("valid")).alias("reason"))


_N = lambda c: f"len(list_filter(regexp_split_to_array({c},'\\s+'), lambda w: w<>''))"
_G = "list_distinct(list_transform(range(1, length(t)-3), lambda i: substr(t,i,5)))"


@query(f"""WITH {_SIDES}, v AS (SELECT *, {_N('q')} AS pre, {_N('good')} AS g, {_N('bad')} AS b FROM p WHERE reason IS NULL), k AS (SELECT * FROM v WHERE pre+greatest(g,b)<=1024 AND g>0 AND b>0),
 t AS (SELECT chosen_id AS id, {_SQ('q')} AS t FROM k), u AS (SELECT id, len(g) AS n, unnest(g) AS x FROM (SELECT id, {_G} AS g FROM t)), near AS (SELECT a.id AS i, b.id AS j FROM u a JOIN u b ON a.x=b.x AND a.id<b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*)>=0.8*(a.n+b.n-count(*)))
 SELECT (SELECT count(*) FROM k) AS pairs, (SELECT count(*) FROM v)-(SELECT count(*) FROM k) AS rejected_pairs, (SELECT coalesce(sum(g),0)::BIGINT FROM k) AS chosen_targets, (SELECT coalesce(sum(b),0)::BIGINT FROM k) AS rejected_targets, (SELECT count(*)-count(DISTINCT t) FROM t) AS duplicate_prompts, (SELECT count(*) FROM near) AS near_prompts""")
def q10_pair_audit(spark, d):
    """Valid pairs: target totals behind the shared prefix, repeated prompts and prompts that are nearly another's."""
    pairs = _pairs(spark, d).filter(shapes.pair_reason(F.col("chosen"), F.col("rejected")).isNull())
    sized = written(pairs.select(F.col("chosen_id").alias("id"), shapes.squeezed(F.element_at("chosen", 1)["content"]).alias("text"), shapes.pair_targets(F.col("chosen"), F.col("rejected"), X.words, 1024).alias("t")))
    kept = sized.filter("t.reason is null")
    near = setjoin.jaccard_join(kept.select("id", "text")).agg(F.count(F.lit(1)).alias("near_prompts"))
    sums = kept.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("t.chosen_targets"), F.lit(0)).alias("chosen_targets"), F.coalesce(F.sum("t.rejected_targets"), F.lit(0)).alias("rejected_targets"), (F.count(F.lit(1)) - F.countDistinct(F.sha2("text", 256))).alias("duplicate_prompts"))
    lost = sized.agg(F.count_if(F.col("t.reason").isNotNull()).alias("rejected_pairs"))
    return sums.crossJoin(lost).crossJoin(near).select("pairs", "rejected_pairs", "chosen_targets", "rejected_targets", "duplicate_prompts", "near_prompts")


@query("""WITH RECURSIVE n AS (SELECT DISTINCT candidate_id AS id, piece_of AS parent, piece_index AS i, split AS s FROM pretrain_records), b AS (SELECT parent, arg_min(id, (CASE s WHEN 'train' THEN '0' ELSE '1' END)||lpad(i::VARCHAR,9,'0')||id) AS child FROM n WHERE parent IS NOT NULL GROUP BY parent),
 w AS (SELECT DISTINCT id AS root, id AS leaf, 1 AS k FROM n WHERE parent IS NULL UNION ALL SELECT w.root, b.child, w.k+1 FROM w JOIN b ON b.parent=w.leaf WHERE w.k<=31) SELECT root, max(k)::BIGINT AS length, arg_max(leaf, k) AS leaf FROM w GROUP BY root""")
def j13_best_child(spark, d):
    """From each whole record down to its best piece (train first, then by place); roles alternate by depth."""
    rows = table(spark, d, "pretrain_records").select("candidate_id", "piece_of", "piece_index", "split").distinct()
    rows = rows.withColumn("role", F.when(F.col("piece_of").isNull(), "whole").otherwise(F.concat(F.lit("piece of "), "piece_of")))
    order = [F.when(F.col("split") == "train", 0).otherwise(1).alias("o1"), F.col("piece_index").alias("o2")]
    return shapes.best_paths(rows, "candidate_id", "piece_of", "role", order)


@query("""SELECT candidate_id FROM (SELECT candidate_id, row_number() OVER (PARTITION BY prompt_norm ORDER BY selection_rank, candidate_id) AS a, row_number() OVER (PARTITION BY exact_digest ORDER BY selection_rank, candidate_id) AS b FROM (SELECT DISTINCT candidate_id, prompt_norm, exact_digest, selection_rank FROM candidates)) WHERE a=1 AND b=1""")
def d3_two_keys(spark, d):
    """Rows that are the first of their prompt and the first of their exact conversation; missing keys are groups of their own."""
    rows = table(spark, d, "candidates").select("candidate_id", F.sha2("prompt_norm", 256).alias("p"), "exact_digest", "selection_rank").distinct()
    at = F.min(F.struct("selection_rank", "candidate_id"))["candidate_id"].alias("candidate_id")
    firsts = [rows.groupBy(key).agg(at).select("candidate_id").distinct() for key in ("p", "exact_digest")]
    return firsts[0].join(firsts[1], "candidate_id", "left_semi")


@query("""SELECT c.candidate_id, c.origin_group_id, c.bucket FROM (SELECT DISTINCT candidate_id, origin_group_id, bucket FROM candidates) c JOIN (SELECT origin_group_id, arg_min(bucket, selection_rank) AS bucket FROM candidates GROUP BY origin_group_id) o USING (origin_group_id, bucket)""")
def j11_claimed_variants(spark, d):
    """Records of the variant that claims their origin."""
    rows = table(spark, d, "candidates")
    claims = rows.groupBy("origin_group_id").agg(F.min_by("bucket", "selection_rank").alias("bucket"))
    return rows.select("candidate_id", "origin_group_id", "bucket").distinct().join(claims, ["origin_group_id", "bucket"])


_KINDS = "(SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL)"


@query(f"""SELECT count(*) FILTER (WHERE a.v IS NOT NULL AND b.v IS NOT NULL) AS both_runs, count(*) FILTER (WHERE b.user_id IS NULL) AS only_first, count(*) FILTER (WHERE a.user_id IS NULL) AS only_second, count(*) FILTER (WHERE a.user_id IS NULL OR b.user_id IS NULL)=0 AS same_keys
 FROM (SELECT * FROM {_KINDS} WHERE event_type='click') a FULL JOIN (SELECT * FROM {_KINDS} WHERE event_type='view') b ON a.user_id=b.user_id""")
def j12_key_sets(spark, d):
    """Two runs aligned by key, and whether their key sets are the same."""
    means = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    a = means.filter("event_type = 'click'").select("user_id", F.col("v").alias("a"), F.lit(True).alias("has_a"))
    b = means.filter("event_type = 'view'").select("user_id", F.col("v").alias("b"), F.lit(True).alias("has_b"))
    no_a, no_b = F.col("has_a").isNull(), F.col("has_b").isNull()
    return a.join(b, "user_id", "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_runs"), F.count_if(no_b).alias("only_first"), F.count_if(no_a).alias("only_second"), (F.count_if(no_a | no_b) == 0).alias("same_keys"))


@query("""WITH o AS (SELECT lower(replace(trim(source),'-','_')) AS source_id, count(*) AS n, count(DISTINCT candidate_id) AS records, max(revision) AS revision FROM pretrain_records GROUP BY ALL)
 SELECT coalesce(s.source_id, o.source_id) AS source_id, s.row_count AS declared, coalesce(o.n,0) AS observed, coalesce(o.records,0) AS records, CASE WHEN s.source_id IS NULL THEN 'undeclared' WHEN o.source_id IS NULL THEN 'missing' WHEN o.records>s.row_count THEN 'more' WHEN o.revision<>s.revision THEN 'revision' ELSE 'within' END AS state FROM sources s FULL JOIN o ON s.source_id=o.source_id""")
def q2_declared_totals(spark, d):
    """Declared rows and revision of every source against what the records say; sources on one side only included."""
    source = F.lower(F.replace(F.trim("source"), F.lit("-"), F.lit("_"))).alias("source_id")
    seen = table(spark, d, "pretrain_records").groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("candidate_id").alias("records"), F.max("revision").alias("r")).withColumn("o", F.lit(True))
    said = table(spark, d, "sources").select(F.col("source_id").alias("s"), F.col("row_count").alias("declared"), "revision")
    both = said.join(seen, said.s == seen.source_id, "full")
    state = F.when(F.col("s").isNull(), "undeclared").when(F.col("o").isNull(), "missing").when(F.col("records") > F.col("declared"), "more").when(F.col("r") != F.col("revision"), "revision").otherwise("within")
    return both.select(F.coalesce("s", "source_id").alias("source_id"), "declared", F.coalesce("n", F.lit(0)).alias("observed"), F.coalesce("records", F.lit(0)).alias("records"), state.alias("state"))


_FIELDS = ("candidate_id", "bucket", "origin_group_id", "split")


@query("SELECT field, count(*) FILTER (WHERE NOT present) AS absent, count(*) FILTER (WHERE present AND said IS DISTINCT FROM held) AS unlike, count(*) AS records FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS field, coalesce(json_exists(provenance_json,'$.{k}'),false) AS present, json_extract_string(provenance_json,'$.{k}') AS said, {k} AS held FROM (SELECT DISTINCT candidate_id, bucket, origin_group_id, split, provenance_json FROM candidates)" for k in _FIELDS) + ") GROUP BY field")
def q7_sidecar_fields(spark, d):
    """Every field that the sidecar repeats against the record's own."""
    rows = table(spark, d, "candidates").select(*_FIELDS, "provenance_json").distinct()
    every = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("field"), shapes.nested(F.col("provenance_json"), k).alias("said"), F.col(k).alias("held")) for k in _FIELDS))).alias("x"))
    present = F.col("x.said.present")
    return every.groupBy(F.col("x.field").alias("field")).agg(F.count_if(~present).alias("absent"), F.count_if(present & ~F.col("x.said.value").eqNullSafe(F.col("x.held"))).alias("unlike"), F.count(F.lit(1)).alias("records"))


@query("""SELECT reason, count(*) AS records FROM (SELECT CASE WHEN sha256(text)<>content_sha256 THEN 'hash' WHEN text_tokens IS NULL THEN 'missing' WHEN text_tokens < len(list_filter(regexp_split_to_array(text,'\\s+'), lambda w: w<>'')) THEN 'fewer_than_words' WHEN nonpad_input_tokens<>text_tokens+2 THEN 'input_tokens' WHEN loss_target_tokens IS NULL OR loss_target_tokens<>text_tokens+1 THEN 'loss_tokens' ELSE 'bound' END AS reason
 FROM (SELECT DISTINCT candidate_id, text, content_sha256, text_tokens, nonpad_input_tokens, loss_target_tokens FROM pretrain_records)) GROUP BY reason""")
def q1_recount(spark, d):
    """Digest and whitespace tokens made anew for every record: the first thing stored that they contradict."""
    rows = table(spark, d, "pretrain_records").select("candidate_id", "text", "content_sha256", "text_tokens", "nonpad_input_tokens", "loss_target_tokens").distinct()
    stored = F.col("text_tokens")
    reason = (
        F.when(F.sha2("text", 256) != F.col("content_sha256"), "hash").when(stored.isNull(), "missing").when(stored < X.word_count(F.col("text")), "fewer_than_words")
        .when(F.col("nonpad_input_tokens") != stored + 2, "input_tokens").when(~F.col("loss_target_tokens").eqNullSafe(stored + 1), "loss_tokens").otherwise("bound")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("records"))


@query("""SELECT DISTINCT t, k, e.item_id FROM (SELECT 'candidates' AS t, candidate_id AS k, prompt_norm AS p FROM candidates UNION ALL SELECT 'eval_reference', item_id::VARCHAR, normalized_prompt FROM eval_reference) x JOIN eval_reference e ON x.p=e.normalized_prompt WHERE NOT (t='eval_reference' AND k=e.item_id::VARCHAR)""")
def j1_exact_hits(spark, d):
    """Test items that stand in the store, or under another id among the items, by digest of the prompt."""
    named = lambda name, key, text: table(spark, d, name).select(F.lit(name).alias("t"), F.col(key).cast("string").alias("k"), F.sha2(F.col(text), 256).alias("p"))
    every = named("candidates", "candidate_id", "prompt_norm").unionByName(named("eval_reference", "item_id", "normalized_prompt"))
    items = table(spark, d, "eval_reference").select("item_id", F.sha2("normalized_prompt", 256).alias("p"))
    hits = every.filter("p is not null").join(items, "p").filter(~((F.col("t") == "eval_reference") & (F.col("k") == F.col("item_id").cast("string"))))
    return hits.select("t", "k", "item_id").distinct()


@query("""SELECT doc_id, (i-1)::INT AS point, loss[i]::BIGINT AS loss, step[i]::BIGINT AS step FROM (SELECT doc_id, loss, step, unnest(range(1, len(loss)+1)) AS i FROM (SELECT doc_id, regexp_extract_all(text,'loss fell to ([0-9]+) after ([0-9]+) steps',1) AS loss, regexp_extract_all(text,'loss fell to ([0-9]+) after ([0-9]+) steps',2) AS step FROM documents))""")
def s13_log_points(spark, d):
    """Log lines in run reports as points of step and loss."""
    pattern = F.lit("loss fell to ([0-9]+) after ([0-9]+) steps")
    found = F.arrays_zip(*(F.transform(F.regexp_extract_all("text", pattern, F.lit(k)), lambda x: x.cast("long")).alias(name) for k, name in ((1, "loss"), (2, "step"))))
    return table(spark, d, "documents").select("doc_id", F.posexplode(found).alias("point", "p")).select("doc_id", "point", "p.loss", "p.step")


@query("""SELECT candidate_id, metric, metric_value FROM (SELECT candidate_id, substr(t.fullkey,3) AS metric, t.atom::DOUBLE AS metric_value, t.type FROM (SELECT DISTINCT candidate_id, provenance_json FROM candidates) c, json_tree(c.provenance_json) t) WHERE type IN ('UBIGINT','BIGINT','DOUBLE')""")
def s18_nested_metrics(spark, d):
    """Numbers anywhere in nested records, flattened to dotted names; truth values are no numbers."""
    kind = "array<struct<metric: string, metric_value: double>>"
    flat = verify.vectorised(verify.flattened, T.StringType(), "provenance_json")
    rows = table(spark, d, "candidates").select("candidate_id", "provenance_json").distinct().select("candidate_id", F.explode(F.from_json(flat, kind)).alias("m"))
    return rows.select("candidate_id", "m.metric", "m.metric_value")


@query("""SELECT split_name, candidate_id, row_number() OVER (PARTITION BY split_name ORDER BY candidate_id) AS line_number FROM (SELECT DISTINCT candidate_id, lower(trim(split)) AS split_name FROM candidates)""")
def s16_split_numbers(spark, d):
    """Line numbers of each split's own file, without sorting a split in one task."""
    rows = table(spark, d, "candidates").select("candidate_id", F.lower(F.trim("split")).alias("split_name")).distinct()
    return budget.ranked(rows, "place", F.col("candidate_id"), by=["split_name"]).select("split_name", "candidate_id", (F.col("place") + 1).alias("line_number"))


@query("""WITH o AS (SELECT lower(replace(trim(source),'-','_')) AS source_id, max(revision) AS revision, max(repo_id) AS repo_id, count(*) AS n FROM pretrain_records GROUP BY ALL)
 SELECT s.source_id, coalesce(s.revision=o.revision,false) AS same_revision, s.license IS NOT NULL AS licensed, coalesce(o.n,0) AS n_rows, coalesce(s.revision=o.revision AND s.repo_id=o.repo_id AND s.license IS NOT NULL,false) AS ready FROM sources s LEFT JOIN o USING (source_id)""")
def s21_source_states(spark, d):
    """Declared sources against what was read of them: revision, licence, rows, and whether all is in order."""
    source = F.lower(F.replace(F.trim("source"), F.lit("-"), F.lit("_"))).alias("source_id")
    seen = table(spark, d, "pretrain_records").groupBy(source).agg(F.max("revision").alias("r"), F.max("repo_id").alias("repo"), F.count(F.lit(1)).alias("n"))
    same = F.coalesce(F.col("revision") == F.col("r"), F.lit(False))
    ready = same & F.coalesce(F.col("repo_id") == F.col("repo"), F.lit(False)) & F.col("license").isNotNull()
    return table(spark, d, "sources").join(seen, "source_id", "left").select("source_id", same.alias("same_revision"), F.col("license").isNotNull().alias("licensed"), F.coalesce("n", F.lit(0)).alias("n_rows"), ready.alias("ready"))


@query("""WITH a AS (SELECT DISTINCT json_extract_string(provenance_json,'$.source_record_locator.line_number')::BIGINT AS k FROM candidates WHERE json_exists(provenance_json,'$.source_record_locator.line_number')), b AS (SELECT DISTINCT line_number AS k FROM raw_pairs WHERE line_number IS NOT NULL)
 SELECT CASE WHEN b.k IS NULL THEN 'only_provenance' WHEN a.k IS NULL THEN 'only_data' ELSE 'both' END AS state, count(*) AS n_lines FROM a FULL JOIN b ON a.k=b.k GROUP BY ALL""")
def j8_line_zip(spark, d):
    """Lines of the raw data against the lines that the sidecars name, longest side first: what either lacks is counted."""
    at = F.get_json_object("provenance_json", "$.source_record_locator.line_number").cast("long")
    a = table(spark, d, "candidates").select(at.alias("k")).filter("k is not null").distinct().withColumn("a", F.lit(True))
    b = table(spark, d, "raw_pairs").select(F.col("line_number").alias("k")).filter("k is not null").distinct().withColumn("b", F.lit(True))
    state = F.when(F.col("b").isNull(), "only_provenance").when(F.col("a").isNull(), "only_data").otherwise("both")
    return a.join(b, "k", "full").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n_lines"))


@query("""WITH r AS (SELECT item_id, 'repeated' AS reason FROM (SELECT item_id, row_number() OVER (PARTITION BY normalized_prompt ORDER BY item_id) AS k FROM eval_reference) WHERE k>1 UNION ALL SELECT item_id, 'no_config' FROM eval_reference WHERE config IS NULL UNION ALL SELECT item_id, 'short' FROM eval_reference WHERE length(normalized_prompt)<60)
 SELECT DISTINCT sha256(reason||'|'||item_id) AS event_id, reason, item_id FROM r""")
def q6_exclusion_events(spark, d):
    """Every exclusion under a name of its own, from its reason and row: the same event twice is one."""
    rows = table(spark, d, "eval_reference").select("item_id", F.sha2("normalized_prompt", 256).alias("p"), "config", F.length("normalized_prompt").alias("n"))
    first = rows.groupBy("p").agg(F.min("item_id").alias("first"))
    told = rows.join(first, "p").select("item_id", F.explode(F.array_compact(F.array(F.when(F.col("item_id") != F.col("first"), "repeated"), F.when(F.col("config").isNull(), "no_config"), F.when(F.col("n") < 60, "short")))).alias("reason"))
    return told.select(F.sha2(F.concat_ws("|", "reason", F.col("item_id").cast("string")), 256).alias("event_id"), "reason", "item_id").dropDuplicates(["event_id"])


@query("""WITH s AS (SELECT DISTINCT shard FROM pretrain_records), c AS (SELECT DISTINCT first_shard AS shard FROM (SELECT first_shard FROM train_chunks UNION ALL SELECT first_shard FROM validation_chunks)) SELECT sha256((SELECT string_agg(x, chr(10) ORDER BY x) FROM (SELECT DISTINCT sha256(normalized_prompt) AS x FROM eval_reference))) AS pattern_sha256,
 (SELECT count(*) FROM s) AS shards, (SELECT count(*) FROM s FULL JOIN c USING (shard) WHERE s.shard IS NULL OR c.shard IS NULL)=0 AS same_roster, (SELECT count(*) FROM eval_reference WHERE sha256(normalized_prompt)<>prompt_sha256) AS changed_patterns, (SELECT count(*) FROM (SELECT digest FROM train_chunks INTERSECT SELECT digest FROM validation_chunks)) AS shared_digests""")
def q4_repair_evidence(spark, d):
    """Evidence of a repair: fingerprint of the patterns, patterns that aren't what their digest says, shard roster on both sides, digests still in both splits."""
    e = table(spark, d, "eval_reference").select(F.sha2("normalized_prompt", 256).alias("x"), "prompt_sha256")
    lists = e.agg(F.sha2(F.array_join(F.array_sort(F.collect_set("x")), "\n"), 256).alias("pattern_sha256"), F.count_if(F.col("x") != F.col("prompt_sha256")).alias("changed_patterns"))  # a fixed table of test items
    s = table(spark, d, "pretrain_records").select("shard", F.lit(True).alias("s")).distinct()
    chunks = [table(spark, d, name) for name in ("train_chunks", "validation_chunks")]
    c = chunks[0].select("first_shard").unionByName(chunks[1].select("first_shard")).select(F.col("first_shard").alias("shard"), F.lit(True).alias("c")).distinct()
    roster = s.join(c, "shard", "full").agg(F.count_if(F.col("s").isNotNull()).alias("shards"), (F.count_if(F.col("s").isNull() | F.col("c").isNull()) == 0).alias("same_roster"))
    both = chunks[0].select("digest").intersect(chunks[1].select("digest")).agg(F.count(F.lit(1)).alias("shared_digests"))
    return lists.crossJoin(roster).crossJoin(both)


@query("""SELECT source_id, task, n, n=expected AS as_expected, empties, revisions=1 AS pinned FROM (SELECT e.source_id, e.task, count(*) AS n, count(*) FILTER (WHERE trim(coalesce(normalized_prompt,''),' ')='') AS empties, count(DISTINCT repo_id||'@'||revision) AS revisions, any_value(x.expected) AS expected FROM eval_reference e JOIN (SELECT source_id, count(DISTINCT item_id) AS expected FROM eval_reference GROUP BY source_id) x USING (source_id) GROUP BY e.source_id, e.task)""")
def q5_benchmark_expectations(spark, d):
    """Each benchmark against an expectation table: rows, empty prompts, one pinned revision."""
    e = table(spark, d, "eval_reference")
    expected = e.groupBy("source_id").agg(F.countDistinct("item_id").alias("expected"))
    seen = e.groupBy("source_id", "task").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("normalized_prompt", F.lit(""))) == "").alias("empties"), F.countDistinct(F.concat_ws("@", "repo_id", "revision")).alias("revisions"))
    return seen.join(expected, "source_id").select("source_id", "task", "n", (F.col("n") == F.col("expected")).alias("as_expected"), "empties", (F.col("revisions") == 1).alias("pinned"))


_CUT = "(SELECT doc_id, source, list_filter(regexp_split_to_array(text,'\\s+'), lambda w: w<>'') AS w, sha256('cut|'||doc_id) AS h FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"


@query(f"""SELECT doc_id, source, least(n, 2000-before)::BIGINT AS kept, array_to_string(w[1:least(n, 2000-before)],' ') AS text, n>2000-before AS cut FROM (SELECT *, len(w) AS n, (coalesce(sum(len(w)) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))::BIGINT AS before FROM {_CUT} WHERE len(w)>0) WHERE before<2000""")
def o11_exact_budget_texts(spark, d):
    """2,000 words of each source to the word: the last text is cut to what is left."""
    rows = table(spark, d, "documents").filter("text is not null and source is not null").select("doc_id", "source", X.words(F.col("text")).alias("w"), X.hash_order("cut", F.col("doc_id")).alias("h"))
    rows = rows.withColumn("n", F.size("w").cast("long")).filter("n > 0")
    kept = budget.take_budget(rows, "n", 2000, ["source"], F.col("h")).withColumn("kept", F.least(F.col("n"), 2000 - F.col("before")))
    return kept.select("doc_id", "source", "kept", F.array_join(F.slice("w", F.lit(1), F.col("kept").cast("int")), " ").alias("text"), (F.col("n") > F.col("kept")).alias("cut"))


@query(f"""WITH k AS (SELECT doc_id, source, len(w) AS n, h FROM {_CUT} WHERE len(w)>=20 AND len(list_distinct(w))*2>=len(w)), t AS (SELECT *, (coalesce(sum(n) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))::BIGINT AS before FROM k), b AS (SELECT * FROM t WHERE before<2000),
 ok AS (SELECT doc_id, source, n AS kept, 'whole' AS state FROM b WHERE before+n<=2000 UNION ALL SELECT doc_id, source, 2000-before, 'cut' FROM b WHERE before+n>2000 AND 2000-before>=20) SELECT doc_id, source, kept::BIGINT AS kept, state FROM ok""")
def o12_budget_after_filters(spark, d):
    """Texts that pass the filters up to 2,000 words a source; a cut piece has to pass them again (20 words), else the source stays short by less than that."""
    rows = table(spark, d, "documents").filter("text is not null and source is not null").select("doc_id", "source", X.words(F.col("text")).alias("w"), X.hash_order("cut", F.col("doc_id")).alias("h"))
    rows = rows.withColumn("n", F.size("w").cast("long")).filter((F.col("n") >= 20) & (F.size(F.array_distinct("w")) * 2 >= F.col("n"))).drop("w")
    kept = budget.take_budget(rows, "n", 2000, ["source"], F.col("h"))
    room, whole = 2000 - F.col("before"), F.col("before") + F.col("n") <= 2000
    return kept.filter(whole | (room >= 20)).select("doc_id", "source", F.when(whole, F.col("n")).otherwise(room).alias("kept"), F.when(whole, "whole").otherwise("cut").alias("state"))
