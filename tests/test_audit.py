import hashlib

from millrace.plans.audit import d4_greedy_near_dedup


def test_greedy_near_dedup_keeps_short_and_missing_prompts(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog while the river runs past the old mill "
    texts = [base, base + "x", base + "xy", "q" + base, "short", "short", "shorted", "", "a" * 49, "a" * 48 + "b", "nothing in common with the others, and long enough to take part", None, None]
    data = [(f"c{i:02}", t) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "candidate_id string, prompt_norm string").write.parquet(str(tmp_path / "candidates.parquet"))
    first: dict = {}
    for i, t in data:
        first.setdefault(i if t is None else t, (i, t))
    gram = lambda t: {t[k : k + 5] for k in range(len(t) - 4)}
    kept: list = []
    for i, t in sorted(first.values(), key=lambda r: hashlib.sha256(r[0].encode()).hexdigest()):
        near = [u for _, u in kept if t and u and len(t) >= 50 and len(u) >= 50 and len(gram(t) & gram(u)) >= 0.85 * len(gram(t) | gram(u))]
        if not near:
            kept.append((i, t))
    assert sorted(r.id for r in d4_greedy_near_dedup(spark, str(tmp_path)).collect()) == sorted(i for i, _ in kept)
    assert len(kept) < len(first)
