import json
import math
import random

from pyspark.sql import functions as F

from millrace.functions import scores as S
from millrace.functions import text as X
from millrace.operators import conversation as C
from millrace.operators import setjoin, shapes


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_presence_is_not_the_same_as_a_value(spark):
    row = '{"a": {"b": null, "c": 0}, "a.b": 1}'
    for path, want in (("a.b", (None, True)), ("a.c", ("0", True)), ("a.d", (None, False)), ("x.y", (None, False))):
        assert tuple(_one(spark, shapes.nested(F.col("r"), path), r=row)) == want
    assert tuple(_one(spark, shapes.nested(F.col("r"), "a"), r=None)) == (None, False)
    scopes = [F.col("f"), F.col("r")]
    assert tuple(_one(spark, shapes.first_present(scopes, ("p", "q")), f='{"q": 1}', r='{"p": null, "q": 2}')) == (None, True)
    assert tuple(_one(spark, shapes.first_present(scopes, ("q", "p")), f='{"q": 1}', r='{"q": 2}')) == ("1", True)
    assert tuple(_one(spark, shapes.first_present(scopes, ("z",)), f="broken", r="{}")) == (None, False)


def test_languages_and_licences(spark):
    for stored, want in ((" C++ ", "cpp"), ('{"name": "C#"}', "csharp"), ('{"name": "", "language": "Go"}', "go"), ('{"id": "R"}', "r"), (None, ""), ("{broken", "{broken")):
        assert _one(spark, shapes.language_value(F.col("v")), v=stored) == want
    assert shapes.license_names('["MIT, Apache-2.0", {"spdx": "BSD; "}, {"x": {"name": "ISC"}}, null, 3]') == ["MIT", "Apache-2.0", "BSD", "ISC", "3"]
    assert shapes.license_names("[broken | MIT") == ["[broken", "MIT"] and shapes.license_names("  ") == shapes.license_names(None) == []
    for path, want in (("src/Vendors/x.py", True), ("third-party\\y", True), ("a/vendored/z", False), ("dist/x", False), (None, False)):
        assert _one(spark, shapes.in_vendor_path(F.col("p")), p=path) is want


def test_adapters(spark):
    row = dict(instruction=" Do it. ", input="x", output=" done ", article="News.", highlights="Short.", context="", response="r")
    get = lambda shape: [m.content for m in _one(spark, shapes.adapted(shape, F.col), **row)]
    assert get("alpaca_en") == ["Do it.\n\nInput:\nx", "done"] and get("alpaca_zh") == ["Do it.\n\n输入：\nx", "done"]
    assert get("context_response") == ["Do it.", "r"] and get("article_summary")[0].endswith("\n\nArticle:\nNews.")


def _conv(spark, messages):
    schema = "conversations array<struct<role:string,content:string,reasoning_content:string,tools:string,tool_calls:string>>"
    return spark.createDataFrame([(json.dumps({"conversations": messages}),)], "p string").select(F.from_json("p", schema)["conversations"].alias("conv"))


def m(role, content="x", **more):
    return {"role": role, "content": content} | more


def test_turn_faults(spark):
    tools, call, two = '[{"name":"f"}]', '[{"name":"f"}]', '[{"name":"f"},{"name":"g"}]'
    s = m("system", tools=tools)
    cases = [
        ([], "empty"), ([m("user"), m("assistant")], None), ([s, m("user"), m("assistant", tool_calls=call), m("tool"), m("assistant")], None), ([m("user"), m("system"), m("assistant")], "system_position"),
        ([m("assistant")], "starts_without_user"), ([s], "starts_without_user"), ([m("user"), m("user"), m("assistant")], "no_assistant"), ([m("user")], "no_assistant"), ([m("user"), m("assistant", tool_calls=call)], "no_tools"),
        ([s, m("user"), m("assistant", tool_calls=two), m("tool"), m("assistant")], "open_call"), ([s, m("user"), m("assistant", tool_calls=two), m("tool"), m("tool"), m("assistant")], None), ([s, m("user"), m("assistant"), m("tool")], "orphan_tool"),
        ([s, m("user"), m("assistant", tool_calls=call), m("user"), m("assistant")], "unclosed_call"), ([s, m("user"), m("assistant", tool_calls=call)], "unclosed_call"),
    ]
    for messages, want in cases:
        assert _conv(spark, messages).select(C.turn_fault(F.col("conv")).alias("x")).first().x == want, (messages, want)


def test_message_faults(spark):
    cases = [
        (m("user"), None), (m("Human"), None), (m("robot"), "role"), (m(None), "role"), (m("system", tools="[]"), "tools_json"), (m("system", tools="no"), "tools_json"), (m("user", tools="[1]"), "tools_role"), (m("assistant", tool_calls="{}"), "tool_calls_json"),
        (m("user", tool_calls="[1]"), "tool_calls_role"), (m("user", reasoning_content="r"), "reasoning_role"), (m("tool", " "), "empty"), (m("assistant", None), "unsupervised"), (m("assistant", None, reasoning_content="r"), None), (m("assistant", "", tool_calls="[1]"), None),
    ]
    for message, want in cases:
        got = _conv(spark, [message]).select(C.message_fault(F.element_at("conv", 1)).alias("x")).first().x
        assert got == want, (message, want, got)


def test_pair_reasons(spark):
    q, a = m("user", "Tell me about towers."), m("assistant", "Tall.")
    cases = [([q, a], [q, m("assistant", "Short.")], None), ([q, a], [q, m("assistant", " TALL. ")], "identical_answers"), ([q, a], [m("user", "Else?"), a], "context_mismatch"), ([q, a, q], [q, a], "context_mismatch"), ([m("user", "Hm?"), a], [m("user", "Hm?"), a], "short_prompt"), ([q, m("user")], [q, a], "schema"), ([q, a], [q, m("assistant", " ")], "schema")]
    for chosen, rejected, want in cases:
        df = _conv(spark, chosen).select(F.col("conv").alias("c")).crossJoin(_conv(spark, rejected).select(F.col("conv").alias("r")))
        assert df.select(shapes.pair_reason(F.col("c"), F.col("r")).alias("x")).first().x == want, want


def test_best_paths(spark):
    rows = [("a", None, "u", 0), ("b", "a", "v", 2), ("c", "a", "v", 1), ("d", "c", "u", 5), ("e", "d", "u", 1), ("z", None, "u", 0), ("y", "z", "u", 0), ("x", "gone", "u", 0)]
    rows += [(f"n{i:02}", f"n{i - 1:02}" if i else None, "uv"[i % 2], 0) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:3], "id string, parent string, role string, rank int")
    got = {r.root: (r.length, r.leaf) for r in shapes.best_paths(df, "id", "parent", "role", [F.col("rank").alias("o")]).collect()}
    assert got == {"a": (3, "d"), "z": (1, "z"), "n00": (32, "n31")}


def test_scores(spark):
    df = spark.createDataFrame([([True, True, False], [True, False, False]), ([], [])], "a array<boolean>, b array<boolean>")
    assert [r.x for r in df.select(S.common_prefix(F.col("a"), F.col("b")).alias("x")).collect()] == [1, 0]
    got = _one(spark, S.preference_loss(F.lit(-1.0), F.lit(-3.0), F.lit(-2.0), F.lit(-2.5), 0.1), a="")
    assert abs(got + math.log(1 / (1 + math.exp(-0.1 * 1.5)))) < 1e-12
    for text, want, found in (("It is 1,234 in all.", 1234, True), ("x12", 12, False), ("-3.50", -3.5, True), ("12.5.", 12, False), ("3", 3, True)):
        assert _one(spark, S.number_in_text(F.col("t"), F.lit(float(want))), t=text) is found, text
    assert _one(spark, X.repetition_penalty(F.col("t")), t="河 水 河 水 河 水") == 0.5 and _one(spark, X.repetition_penalty(F.col("t")), t="a b!") == 0.0


def test_bootstrap_means_are_means_of_resamples(spark):
    rows = spark.createDataFrame([("a", i, float(i % 5)) for i in range(50)] + [("b", 1, 7.0)], "g string, i int, v double")
    got = S.bootstrap_means(rows, ["g"], "v", F.col("i"), 400).collect()
    a = [r["mean"] for r in got if r.g == "a"]
    assert len(a) == 400 and {r["mean"] for r in got if r.g == "b"} == {7.0}
    spread = (sum((x - 2) ** 2 for x in a) / 400) ** 0.5
    assert abs(sum(a) / 400 - 2) < 0.05 and abs(spread - (2 / 50) ** 0.5) < 0.03


def test_jaccard_join_with_split_lists(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "HOT_LIST", 5)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(3, 60))) for _ in range(30)]
    texts = base + [t[:k] + "x" + t[k:] for t in base for k in (0, len(t) // 2)] + ["common part " + t for t in base]
    gram = lambda t: {t[k : k + 5] for k in range(len(t) - 4)}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    near = lambda i, j: gram(texts[i]) | gram(texts[j]) and len(gram(texts[i]) & gram(texts[j])) / len(gram(texts[i]) | gram(texts[j])) >= 0.7
    want = {(i, j) for i in range(len(texts)) for j in range(len(texts)) if near(i, j)}
    assert {(r.id_a, r.id_b) for r in setjoin.jaccard_join(df, None, 5, 0.7).collect()} == {(i, j) for i, j in want if i < j}
    left, right = df.filter("id < 60"), df.filter("id >= 60")
    assert {(r.id_a, r.id_b) for r in setjoin.jaccard_join(left, right, 5, 0.7).collect()} == {(i, j) for i, j in want if i < 60 <= j}
    assert setjoin.jaccard_join(df.limit(0)).count() == 0
