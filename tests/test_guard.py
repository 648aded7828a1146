import random

from pyspark.sql import functions as F

from millrace.plans import corpus


def _grams(t):
    return {t[k : k + 5] for k in range(len(t) - 4)}


def _tables(spark, folder):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).strip() + "z"
    items = [letters(rng.randint(15, 120)) for _ in range(25)] + ["abcd", "x" * 30]
    held = [letters(rng.randint(15, 120)) for _ in range(25)]
    train = [letters(60) for _ in range(10)]
    for p in items + held:
        k = rng.randint(0, len(p))
        train += [p, letters(20) + p + letters(9), p[: max(20, len(p) // 2)], p[:k] + "q" + p[k:], p[:k] + letters(12) + p[k:], p[3:19]]
    rows = [(f"t{i:03}", " Train", p) for i, p in enumerate(train)] + [(f"h{i:03}", rng.choice(["test", "validation"]), p) for i, p in enumerate(held)]
    rows += [rows[0], ("t900", "train", None), ("h900", "test", None), ("n900", None, items[0])]
    docs = [(i, t if i % 2 else t.upper().replace(" ", " \n ")) for i, t in enumerate(train)] + [(999, None)]
    spark.createDataFrame(rows, "candidate_id string, split string, prompt_norm string").write.parquet(f"{folder}/candidates.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(500, items[1])], "item_id long, normalized_prompt string").write.parquet(f"{folder}/eval_reference.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return rows, list(enumerate(items)) + [(500, items[1])], docs


def _reason(p, held):
    if p is None:
        return None
    if p in held:
        return "exact"
    if any(len(p) >= 20 and len(h) >= 20 and (h in p or p in h) for h in held):
        return "containment"
    near = any(_grams(p) | _grams(h) and len(_grams(p) & _grams(h)) >= 0.8 * len(_grams(p) | _grams(h)) for h in held)
    return "near" if near else None


def test_guard_gives_the_first_reason(spark, tmp_path):
    rows, items, _ = _tables(spark, str(tmp_path))
    held = {p for _, s, p in rows if s in ("test", "validation") and p} | {p for _, p in items}
    want = sorted(((i, _reason(p, held)) for i, s, p in rows if s and s.strip().lower() == "train"), key=repr)
    got = sorted(((r.candidate_id, r.reason) for r in corpus.j9_guard(spark, str(tmp_path)).collect()), key=repr)
    assert got == want and {r for _, r in want} == {None, "exact", "containment", "near"}


def test_training_text_near_test_items(spark, tmp_path):
    rows, items, docs = _tables(spark, str(tmp_path))
    texts = {("candidates", i, p) for i, _, p in rows if p} | {("documents", str(i), " ".join(t.casefold().split())) for i, t in docs if t}
    score = lambda t, p: len(_grams(t) & _grams(p)) / max(1, len(_grams(t) | _grams(p)))
    want = {(n, i, k, round(score(t, p), 9)) for n, i, t in texts for k, p in items if score(t, p) >= 0.8}
    got = {(r.record_table, r.record_key, r.item_id, round(r.jaccard, 9)) for r in corpus.j6_training_pairs(spark, str(tmp_path)).collect()}
    assert got == want and {n for n, *_ in want} == {"candidates", "documents"}
    some = {(r.record_table, r.record_key, r.item_id, round(r.jaccard, 9)) for r in corpus.j4_simhash_pairs(spark, str(tmp_path)).filter(F.col("jaccard") < 1).collect()}
    below = {r for r in want if r[3] < 1}
    assert some <= below and len(some) >= 0.8 * len(below) > 0 and {n for n, *_ in some} == {"candidates", "documents"}
    assert corpus.j4_simhash_pairs(spark, str(tmp_path)).filter("jaccard >= 1").isEmpty()
