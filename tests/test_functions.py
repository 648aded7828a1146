import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import verify
from millrace.functions.unicode import distinct_grams, joined_windows, letters_digits, spaced


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], names) if names else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_normal_forms_on_special_letters():
    assert letters_digits("Straße №5, é!", nfkc=True) == "strasseno5é"
    assert letters_digits(None) == "" and letters_digits("…") == ""
    assert spaced("  A \tB ") == "a b"


def test_windows_hash_alike_wherever_they_stand():
    h, owner, at = joined_windows(["abcde", "xxabcdexx", "ab"], 5)
    where = {(o, p): v for v, o, p in zip(h.tolist(), owner.tolist(), at.tolist())}
    assert where[0, 0] == where[1, 2] and len(where) == 6
    hashes, rows = distinct_grams(["aaaaaa", "", "abcdef"], 5)
    assert rows.tolist() == [0, 2, 2] and len(set(hashes.tolist())) == 3


@pytest.mark.parametrize("text,whole,none,prefix", [("", 1, 0, 1), ("abcd", 1, 0, 1), ("abcde", 1, 1, 1), ("abcdef", 2, 2, 2), ("aaaaaaa", 1, 1, 1)])
def test_shingles_of_short_texts(spark, text, whole, none, prefix):
    got = [one(spark, F.size(X.shingles(F.col("t"), 5, s)), t=text) for s in ("whole", "none", "prefix")]
    assert got == [whole, none, prefix]


def test_masks_and_labels(spark):
    ids = [9, 1, 2, 5, 6, 3, 7, 1, 2, 8]
    assert one(spark, X.span_mask(F.col("i"), [1, 2], [3]), i=ids) == [-100, -100, -100, 5, 6, 3, -100, -100, -100, 8]
    assert one(spark, X.prefix_masked(F.col("p"), F.col("r"), 5), p=[1, 2], r=[3, 4, 5, 6]) == [-100, -100, 3, 4, 5]
    assert one(spark, X.target_count(F.col("i")), i=[-100, -100, 3, 4]) == 2


def test_stable_hash_separates_parts(spark):
    a = one(spark, X.stable_hash(F.col("a"), F.col("b")), a="ab", b="c")
    b = one(spark, X.stable_hash(F.col("a"), F.col("b")), a="a", b="bc")
    want = hashlib.sha256((2).to_bytes(8, "big") + b"ab" + (1).to_bytes(8, "big") + b"c").hexdigest()
    assert a == want and a != b


def test_packed_digests_differ_by_byte_order(spark):
    assert one(spark, F.hex(X.packed_ids(F.col("i"))), i=[1, 258]) == "0000000100000102"
    assert one(spark, F.hex(X.packed_ids(F.col("i"), True)), i=[1, 258]) == "0100000002010000"


def test_mod5_of_whole_digest(spark):
    for s in ("a", "b", "xyz"):
        h = hashlib.sha256(s.encode()).hexdigest()
        assert one(spark, X.hash_mod5(F.col("h")), h=h) == int(h, 16) % 5


@pytest.mark.parametrize(
    "prompt,answer,status",
    [
        ("Answer without any commas.", "no commas here", "pass"),
        ("Answer without any commas.", "one, two", "fail"),
        ("Reply in valid JSON.", '{"a": 1}', "pass"),
        ("Reply in valid JSON.", "a: 1", "fail"),
        ("Use capital letters only.", "ALL BIG", "pass"),
        ("Use capital letters only.", "Not all", "fail"),
        ("Write at least three words.", "one two three", "pass"),
        ("Write at most two words.", "one two three", "fail"),
        ("Answer with exactly 2 bullet points.", "- a\n- b", "pass"),
        ("Answer with exactly 2 bullet points.", "- a\n- b\n- c", "fail"),
        ("Put a title in double angular brackets <<title>>.", "<<T>> body", "pass"),
        ("Give two different responses.", "a ****** b", "pass"),
        ("Say anything.", "anything", "none"),
    ],
)
def test_constraint_verdicts(prompt, answer, status):
    assert verify.verdict(prompt, answer)["status"] == status


def test_parsers():
    assert verify.arithmetic("2 + 3 * 4 ^ 2") == 50 and verify.arithmetic("__import__('os')") is None and verify.arithmetic("1/0") is None and verify.arithmetic("9**9**9") is None
    assert verify.embedded_json('x {"b":1,"a":{"c":2}} y {bad} {"z":[]}') == ['{"a":{"c":2},"b":1}', '{"z":[]}']
    assert verify.boxed("so \\boxed{\\frac{1}{2}}.") == ["so", "\\frac{1}{2}"] and verify.boxed("\\boxed{1} and more") is None
    assert [m["role"] for m in verify.marked_chat("USER: a\nASSISTANT: b\nFUNCTION RESPONSE: {}")] == ["user", "assistant", "tool"]
    spec = '{"properties":{"a":{"type":"integer","maximum":5}},"required":["a"]}'
    assert [verify.tool_argument_fault(c, spec) for c in ('{"a":1}', "{}", '{"a":1,"b":2}', '{"a":"x"}', '{"a":9}', "x")] == [None, "required", "unknown", "type", "bounds", "json"]
    assert verify.requirement("Use at least three words") == {"kind": "word", "low": 3, "high": None}
