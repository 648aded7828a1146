"""Text scalars, hashing, token arrays and scans over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..runtime import table
from .registry import query


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@query("""SELECT doc_id, lower(regexp_replace(text,'[^\\p{L}\\p{N}]','','g')) AS n1, trim(regexp_replace(replace(lower(text),'ß','ss'),'\\s+',' ','g')) AS n2,
 regexp_replace(replace(lower(text),'ß','ss'),'[^0-9a-z]','','g') AS n3, regexp_replace(replace(lower(text),'ß','ss'),'[^\\p{L}\\p{N}_]','','g') AS n4,
 regexp_replace(replace(lower(text),'ß','ss'),'[^\\p{L}\\p{N}]','','g') AS n6, lower(trim(regexp_replace(text,'\\s+',' ','g'))) AS n7 FROM documents""")
def t1_normal_forms(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", X.alnum_lower(t).alias("n1"), X.spaced_casefold(t).alias("n2"), X.ascii_alnum(t).alias("n3"), X.word_chars(t).alias("n4"), X.alnum_casefold(t).alias("n6"), X.spaced_lower(t).alias("n7"))


@query()
def t1_normal_forms_exact(spark, d):
    return _docs(spark, d).select("doc_id", X.alnum_lower_exact("text").alias("n1"), X.spaced_casefold_exact("text").alias("n2"))


_GRAMS = "CASE WHEN length(normalized_prompt) >= 5 THEN list_distinct(list_transform(range(1, length(normalized_prompt)-3), lambda i: substr(normalized_prompt, i, 5))) ELSE {short} END"


@query(f"""SELECT item_id, len({_GRAMS.format(short='[normalized_prompt]')})::BIGINT AS whole_grams, len({_GRAMS.format(short='[]')})::BIGINT AS none_grams,
 len({_GRAMS.format(short='[substr(normalized_prompt,1,5)]')})::BIGINT AS prefix_grams FROM eval_reference""")
def t2_shingles(spark, d):
    rows = table(spark, d, "eval_reference")
    return rows.select("item_id", *(F.size(X.shingles(F.col("normalized_prompt"), 5, s)).cast("long").alias(f"{s}_grams") for s in ("whole", "none", "prefix")))


@query("""SELECT item_id, g AS win FROM (SELECT item_id, unnest(list_distinct(list_transform(range(1, length(normalized_prompt)-18), lambda i: substr(normalized_prompt, i, 20)))) AS g
 FROM eval_reference WHERE length(normalized_prompt) >= 20)""")
def t5_windows(spark, d):
    rows = table(spark, d, "eval_reference").filter("length(normalized_prompt) >= 20")
    return rows.select("item_id", F.explode(X.shingles(F.col("normalized_prompt"), 20, "none")).alias("win"))


@query("""WITH a AS (SELECT task, list_distinct(string_split(string_agg(normalized_prompt,' ' ORDER BY item_id),' ')) AS w FROM eval_reference GROUP BY task)
 SELECT x.task AS task_a, y.task AS task_b, len(list_intersect(x.w,y.w))::DOUBLE/len(list_distinct(list_concat(x.w,y.w))) AS jaccard FROM a x JOIN a y ON x.task < y.task""")
def t8_jaccard(spark, d):
    sets = table(spark, d, "eval_reference").select("task", F.explode(F.split("normalized_prompt", " ")).alias("w")).groupBy("task").agg(F.collect_set("w").alias("w"))
    a, b = sets.select(F.col("task").alias("task_a"), F.col("w").alias("wa")), sets.select(F.col("task").alias("task_b"), F.col("w").alias("wb"))
    return a.join(F.broadcast(b), F.col("task_a") < F.col("task_b")).select("task_a", "task_b", X.jaccard(F.col("wa"), F.col("wb")).alias("jaccard"))


_W = "list_filter(regexp_split_to_array(text,'\\s+'), lambda w: w <> '')"


@query(f"""SELECT doc_id, n AS tokens, n+1 AS loss_targets, least(n,766)+2 AS nonpad, 768::BIGINT AS padded FROM (SELECT doc_id, len({_W})::BIGINT AS n FROM documents WHERE text IS NOT NULL)""")
def t13_token_accounting(spark, d):
    n = X.word_count(F.col("text")).cast("long")
    return _docs(spark, d).filter("text is not null").select("doc_id", n.alias("tokens"), (n + 1).alias("loss_targets"), (F.least(n, F.lit(766)) + 2).alias("nonpad"), F.lit(768).cast("long").alias("padded"))


@query(f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(0, len(w), 64)) AS a FROM w WHERE len(w)>0)
 SELECT doc_id, (a//64)::BIGINT AS piece, len(w[a+1:a+64])::BIGINT AS tokens, array_to_string(w[a+1:a+64],' ') AS piece_text FROM p""")
def t14_token_chunks(spark, d):
    parts = _docs(spark, d).select("doc_id", F.posexplode(X.chunks_of(X.words(F.col("text")), 64)).alias("piece", "w"))
    return parts.select("doc_id", F.col("piece").cast("long"), F.size("w").cast("long").alias("tokens"), F.array_join("w", " ").alias("piece_text"))


_IDS = f"list_transform({_W}, lambda w: (('0x'||substr(sha256(w),1,7))::BIGINT % 6397 + 3))"


def _ids(t):
    return F.transform(X.words(t), lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 7), 16, 10).cast("long") % 6397 + 3)


@query(f"""WITH i AS (SELECT doc_id, {_IDS} AS ids FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, list_concat([1::BIGINT], ids[1:766], [2::BIGINT]) AS b FROM i), q AS (SELECT doc_id, list_concat(b, list_transform(range(0, greatest(0, 768-len(b))), lambda x: 0::BIGINT)) AS ids FROM p)
 SELECT doc_id, array_to_string(ids,' ') AS ids, array_to_string(list_transform(ids, lambda x: CASE WHEN x=0 THEN -100 ELSE x END),' ') AS labels,
 len(list_filter(ids[2:], lambda x: x<>0))::BIGINT AS targets FROM q""")
def t15_padded_labels(spark, d):
    rows = _docs(spark, d).filter("text is not null").select("doc_id", X.padded(_ids(F.col("text")), 768, 1, 2, 0).alias("ids"))
    rows = rows.withColumn("labels", X.labels_of(F.col("ids"), 0))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return rows.select("doc_id", join(F.col("ids")).alias("ids"), join(F.col("labels")).alias("labels"), X.target_count(F.col("labels")).cast("long").alias("targets"))


@query(f"""WITH i AS (SELECT doc_id, {_IDS} AS ids FROM documents WHERE text IS NOT NULL) SELECT doc_id,
 array_to_string(list_concat(list_transform(ids[1:len(ids)//2], lambda x: -100::BIGINT), ids[len(ids)//2+1:])[1:768],' ') AS labels FROM i""")
def t17_prefix_mask(spark, d):
    ids = _ids(F.col("text"))
    rows = _docs(spark, d).filter("text is not null").select("doc_id", ids.alias("ids")).withColumn("half", F.expr("size(ids) div 2").cast("int"))
    labels = X.prefix_masked(F.slice("ids", F.lit(1), F.col("half")), F.slice("ids", F.col("half") + 1, F.greatest(F.size("ids") - F.col("half"), F.lit(0))), 768)
    return rows.select("doc_id", F.array_join(F.transform(labels, lambda x: x.cast("string")), " ").alias("labels"))


@query()
def t16_span_mask(spark, d):
    ids = _ids(F.col("text"))
    rows = _docs(spark, d).filter("text is not null").select("doc_id", F.transform(ids, lambda x: (x % 7).cast("int")).alias("ids"))
    return rows.select("doc_id", F.size(F.filter(X.span_mask(F.col("ids"), [1, 2], [3]), lambda x: x != -100)).alias("kept"))


@query(f"""WITH i AS (SELECT doc_id, {_IDS} AS ids FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(ids)>=2 AND len(list_filter(ids, lambda x: x<0 OR x>=6000))=0 AS valid FROM i""")
def f13_token_rows(spark, d):
    rows = _docs(spark, d).filter("text is not null").select("doc_id", _ids(F.col("text")).alias("ids"))
    return rows.select("doc_id", X.token_row_valid(F.col("ids"), F.col("ids"), 6000).alias("valid"))


@query()
def t11_content_digests(spark, d):
    ids = _ids(F.col("text"))
    rows = _docs(spark, d).filter("text is not null").select("doc_id", ids.alias("ids"))
    framed = F.concat(F.array(F.lit(1).cast("long")), "ids", F.array(F.lit(2).cast("long")))
    return rows.select("doc_id", F.sha2(X.packed_ids(F.col("ids")), 256).alias("content_digest"), F.sha2(X.packed_ids(framed, True), 256).alias("chunk_digest"))


@query("""SELECT item_id, 1 - len(list_distinct(list_transform(range(1, length(normalized_prompt)-2), lambda i: substr(normalized_prompt,i,4))))::DOUBLE/(length(normalized_prompt)-3) AS ratio FROM eval_reference WHERE length(normalized_prompt)>=4""")
def t19_repetition_ratio(spark, d):
    return table(spark, d, "eval_reference").filter("length(normalized_prompt) >= 4").select("item_id", X.repetition_ratio(F.col("normalized_prompt")).alias("ratio"))


@query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(normalized_prompt),'([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\p{Z}\\s])',1) AS w FROM eval_reference),
 g AS (SELECT item_id, list_transform(range(1, len(w)-1), lambda i: array_to_string(w[i:i+2],' ')) AS g FROM w)
 SELECT item_id, CASE WHEN len(g)>0 THEN least(0.5, (len(g)-len(list_distinct(g)))*0.5*2/len(g))::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM g""")
def t20_repetition_penalty(spark, d):
    return table(spark, d, "eval_reference").select("item_id", X.repetition_penalty(F.col("normalized_prompt")).cast("double").alias("penalty"))


@query("""SELECT record_id, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes, len(regexp_extract_all(text,'(?m)^[ \\t]*[-*•][ \\t]+'))::BIGINT AS bullets,
 len(regexp_extract_all(text,'(?m)^[ \\t]*(?:[-*•]|[0-9]+[.)、])[ \\t]*'))::BIGINT AS items, len(regexp_extract_all(text,'\\*\\*[^*\\n]+\\*\\*'))::BIGINT AS bold,
 len(list_filter(regexp_split_to_array(text,'[.!?。！？]+'), lambda s: trim(s)<>''))::BIGINT AS sentences FROM raw_pairs""")
def t22_text_counts(spark, d):
    t = F.col("text")
    counts = {"chars": F.length(t), "bytes": F.octet_length(t), "bullets": X.bullet_count(t), "items": X.list_item_count(t), "bold": X.count_of(t, r"\*\*[^*\n]+\*\*"), "sentences": X.sentence_count(t)}
    return table(spark, d, "raw_pairs").select("record_id", *(c.cast("long").alias(k) for k, c in counts.items()))


@query("""WITH a AS (SELECT record_id, trim(split_part(text, E'\\nA: ', 2)) AS a FROM raw_pairs WHERE contains(text, E'\\nA: '))
 SELECT record_id, CASE WHEN regexp_matches(a,'^[+-]?[0-9]{1,18}$') THEN a::BIGINT END AS whole,
 len(regexp_extract_all(regexp_replace(a,'(\\d),(\\d{3})','\\1\\2','g'),'-?[0-9]+(?:\\.[0-9]+)?'))::BIGINT AS numbers FROM a""")
def t28_parsed_answers(spark, d):
    rows = table(spark, d, "raw_pairs").filter(F.contains("text", F.lit("\nA: "))).select("record_id", F.trim(F.split_part("text", F.lit("\nA: "), F.lit(2))).alias("a"))
    return rows.select("record_id", X.parse_integer(F.col("a")).alias("whole"), F.size(X.numbers_in(F.col("a"))).cast("long").alias("numbers"))


@query("""SELECT item_id, CASE WHEN len(list_distinct(regexp_extract_all(upper(normalized_prompt),'\\b([A-D])\\b',1)))=1 THEN regexp_extract(upper(normalized_prompt),'\\b([A-D])\\b',1) END AS choice FROM eval_reference""")
def t27_parsed_choice(spark, d):
    return table(spark, d, "eval_reference").select("item_id", X.parse_choice(F.upper("normalized_prompt")).alias("choice"))


_CLS = "length(regexp_replace(text,'[^{c}]','','g'))"


@query(f"""SELECT source, count(*) AS docs, sum({_CLS.format(c='一-鿿')})::BIGINT AS cjk, sum({_CLS.format(c='A-Za-z')})::BIGINT AS latin, sum({_CLS.format(c='0-9')})::BIGINT AS digit,
 count(*) FILTER (WHERE {_CLS.format(c='一-鿿')} > 0) AS cjk_docs FROM documents WHERE text IS NOT NULL GROUP BY source""")
def a14_script_totals(spark, d):
    t = F.col("text")
    return _docs(spark, d).filter("text is not null").groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), *(F.sum(X.script_chars(t, k)).alias(k) for k in ("cjk", "latin", "digit")), F.count_if(X.script_chars(t, "cjk") > 0).alias("cjk_docs")
    )


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text),'\\b(def|class|return|import)\\b|```') THEN 'code' WHEN regexp_matches(lower(text),'\\b(answer|equals|total|sum)\\b|答案') THEN 'math'
 WHEN regexp_matches(lower(text),'\\b(report|news)\\b') THEN 'news' WHEN length(regexp_replace(text,'[^一-鿿]','','g'))::DOUBLE/greatest(length(text),1) >= 0.35 THEN 'cjk'
 WHEN length(regexp_replace(text,'[^A-Za-z]','','g'))::DOUBLE/greatest(length(text),1) >= 0.55 THEN 'latin' ELSE 'other' END AS domain FROM documents WHERE text IS NOT NULL""")
def f18_domains(spark, d):
    t, n = F.col("text"), F.greatest(F.length("text"), F.lit(1))
    domain = F.when(F.lower(t).rlike(r"\b(def|class|return|import)\b|```"), "code").when(F.lower(t).rlike(r"\b(answer|equals|total|sum)\b|答案"), "math").when(F.lower(t).rlike(r"\b(report|news)\b"), "news")
    domain = domain.when(X.script_chars(t, "cjk") / n >= 0.35, "cjk").when(X.script_chars(t, "latin") / n >= 0.55, "latin").otherwise("other")
    return _docs(spark, d).filter("text is not null").select("doc_id", domain.alias("domain"))


@query(f"""WITH w AS (SELECT doc_id, text, {_W} AS w FROM documents WHERE text IS NOT NULL), r AS (SELECT CASE WHEN trim(regexp_replace(text,'\\s+',' ','g'))='' THEN 'blank' WHEN len(w)>30 AND len(list_distinct(w))::DOUBLE/len(w)<0.2 THEN 'repetitive' WHEN length(text)<20 THEN 'short' ELSE 'kept' END AS reason FROM w)
 SELECT reason, count(*) AS docs FROM r GROUP BY reason""")
def f8_first_reason(spark, d):
    t = F.col("text")
    w = X.words(t)
    reason = F.when(F.trim(F.regexp_replace(t, r"\s+", " ")) == "", "blank").when((F.size(w) > 30) & (F.size(F.array_distinct(w)) / F.size(w) < 0.2), "repetitive").when(F.length(t) < 20, "short").otherwise("kept")
    return _docs(spark, d).filter("text is not null").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT doc_id, source FROM documents WHERE text IS NULL OR NOT regexp_matches(text,'\\S')")
def f1_blank_rows(spark, d):
    return _docs(spark, d).filter(F.col("text").isNull() | ~F.col("text").rlike(r"\S")).select("doc_id", "source")


@query("""SELECT coalesce(lower(trim(lang)),'und') AS lang_name, CASE WHEN source LIKE '%code%' THEN 'code' WHEN source LIKE 'math%' THEN 'math' WHEN lower(trim(lang))='zh' THEN 'chinese' ELSE 'general' END AS bucket, count(*) AS docs FROM documents GROUP BY ALL""")
def f11_bucket_routing(spark, d):
    lang = X.language_name(F.col("lang"))
    bucket = F.when(F.contains("source", F.lit("code")), "code").when(F.startswith("source", F.lit("math")), "math").when(lang == "zh", "chinese").otherwise("general")
    return _docs(spark, d).groupBy(F.coalesce(lang, F.lit("und")).alias("lang_name"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("docs"))


@query("""SELECT source_id, coalesce(lower(regexp_replace(trim(license),'[\\s_]+','-','g')),'unknown') AS license_name, regexp_replace(repo_id,'^.*/','') AS repo, list_contains(['data','vendor'], split_part(raw_path,'/',1)) AS vendored FROM sources""")
def f5_licenses(spark, d):
    licence = F.coalesce(F.get(X.license_values(F.col("license")), F.lit(0)), F.lit("unknown"))
    return table(spark, d, "sources").select("source_id", licence.alias("license_name"), F.regexp_replace("repo_id", "^.*/", "").alias("repo"), F.split_part("raw_path", F.lit("/"), F.lit(1)).isin("data", "vendor").alias("vendored"))


@query("""SELECT doc_id, (list_sum(list_transform(string_split(sha256(doc_id::VARCHAR),''), lambda c: ('0x'||c)::INT)) % 5)::BIGINT AS mod5, sha256('42|'||doc_id::VARCHAR) AS order_key,
 ('0x'||substr(sha256(doc_id::VARCHAR),1,8))::BIGINT % 100 AS mod100, substr(sha256(doc_id::VARCHAR),1,16) < '4000000000000000' AS quarter FROM documents""")
def o1_hashes(spark, d):
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    return _docs(spark, d).select("doc_id", X.hash_mod5(h).cast("long").alias("mod5"), X.hash_order("42", F.col("doc_id")).alias("order_key"), X.hash_mod(h, 100).alias("mod100"), X.sampled(h, 0.25).alias("quarter"))


@query()
def o1_stable_hash(spark, d):
    return _docs(spark, d).select("doc_id", X.stable_hash(F.col("source"), F.col("doc_id"), F.col("text")).alias("stable"))


@query("""SELECT event_type, count(*) AS n, count(props) AS with_props, count(*) FILTER (WHERE json_valid(props)) AS valid, count(*) FILTER (WHERE trim(props)='') AS blank FROM events GROUP BY event_type""")
def s4_tolerant_json(spark, d):
    parsed = F.try_parse_json(F.col("props"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("props").alias("with_props"), F.count(parsed).alias("valid"), F.count_if(F.trim("props") == "").alias("blank"))


@query("""SELECT event_type, string_agg(DISTINCT k, ',' ORDER BY k) AS fields FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY event_type""")
def s5_field_discovery(spark, d):
    keys = table(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("k"))
    return keys.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_set("k")), ",").alias("fields"))


@query("SELECT * EXCLUDE (text) FROM pretrain_records")
def f15_provenance_rows(spark, d):
    return table(spark, d, "pretrain_records").drop("text")


@query("SELECT item_id, concat_ws(' ', trim(task), trim(config), trim(split), source_line_number::VARCHAR) AS query_text FROM eval_reference")
def t39_query_concat(spark, d):
    return table(spark, d, "eval_reference").select("item_id", F.concat_ws(" ", F.trim("task"), F.trim("config"), F.trim("split"), F.col("source_line_number").cast("string")).alias("query_text"))
