import json
import random

from pyspark.sql import functions as F

from millrace.functions.unicode import letters_digits
from millrace.llm import formatdup, leakage, mixing, overlap, packing, queries, spans, splitting


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- splitting


def test_pieces_give_the_text_back_and_respect_the_limit():
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice(["a", "b c", "\n", "\n\n", ". ", "。", "# h\n", "- i\n", "```\n", "é", "👍🏽", "1. ", "\t"]) for _ in range(rng.randint(0, 120)))
        for limit, over in ((10, 0), (10, 4), (50, 20), (1, 0)):
            cut = splitting.spans(t, limit, over)
            assert "".join(t[a:b] for a, b in cut) == t
            assert all(0 < len(p) <= limit for p in splitting.pieces(t, limit, over))
            for (a, _), p in list(zip(cut, splitting.pieces(t, limit, over)))[1:]:
                assert p.startswith(t[max(0, a - over) : a])


def test_cuts_fall_on_the_highest_boundary_that_fits():
    t = "# One\n" + "a. " * 20 + "\n# Two\n" + "b. " * 20 + "\n# Three\n" + "c. " * 20
    assert [p.split("\n")[0] for p in splitting.pieces(t, 80)] == ["# One", "# Two", "# Three"]
    assert [len(p) for p in splitting.pieces("x" * 25, 10)] == [10, 10, 5]
    assert splitting.pieces("Hello there. How are you?", 15) == ["Hello there. ", "How are you?"]
    fenced = "```\n# no heading\n```\n"
    assert splitting.pieces(fenced * 2, 25) == [fenced, fenced]


def test_markup_is_cut_at_the_outermost_elements():
    item = lambda k: f"<li>item {k} of the long list</li>"
    t = "<section><p>" + "a b. " * 8 + "</p></section><section><ul>" + "".join(map(item, range(4))) + "</ul></section>"
    assert [p[:10] for p in splitting.pieces(t, 160)] == ["<section><", "<section><"]
    got = splitting.cuts(t, 100)
    assert {splitting.BOUNDARIES[k] for _, _, k in got[1:]} == {"element"} and all(t[a] == "<" for a, _, _ in got)
    assert [t[a:b].count("<li>") for a, b, _ in got] == [0, 2, 2]


def test_boundaries_are_named():
    t = "# A\n" + "x y. " * 4 + "\n\n" + "z" * 50 + "\n# B\nend " + "w" * 20
    assert [splitting.BOUNDARIES[k] for _, _, k in splitting.cuts(t, 30)] == ["section", "block", "character", "section"]


def test_no_better_boundary_is_passed_over():
    """A piece never runs over a boundary of a higher level than the one it is cut at, unless it starts at that boundary."""
    rng = random.Random(13)
    for _ in range(200):
        t = "\n\n".join(" ".join("word" * rng.randint(1, 3) for _ in range(rng.randint(1, 30))) + "." for _ in range(rng.randint(2, 8)))
        for a, b, k in splitting.cuts(t, 120)[1:]:
            if splitting.BOUNDARIES[k] in ("word", "clause"):
                before = t.rfind("\n\n", 0, a)
                assert t.find("\n\n", a) - before > 120 or t.find("\n\n", a) < 0 and len(t) - before > 120


def test_split_table(spark):
    df = spark.createDataFrame([("a", "w " * 40, 1), ("a", "w " * 40, 1), ("b", "short", 2), ("c", None, 3), ("d", "", 4), (None, "z" * 90, 5)], "candidate_id string, text string, piece_index int")
    got = splitting.split_long(df, limit=50, overlap=10)
    assert got.filter("piece_of = 'a'").count() == 2 and got.filter("piece_of is null").count() == 2 and got.select("piece_of").distinct().count() == 2
    assert splitting.split_long(df.limit(0), limit=50, overlap=0).count() == 0


# ---- format copies


def test_format_copies(spark):
    m = lambda c, **k: {"role": "user", "content": c} | k
    payloads = {
        "b": [m("Hello, World")], "a": [m("hello world", tools=None)], "c": [m("HELLO\tworld!")], "d": [m("hello world", tools="[]")], "e": [m("hello"), m("world")], "f": [m(None)], "g": [m("")], "h": [m("Straße")], "i": [m("STRASSE")],
    }
    data = [(k, json.dumps({"conversations": v}), k) for k, v in payloads.items()] + [("j", '{"conversations":[{"content":"hello, world","role":"user"}]}', "j"), ("k", "broken", ""), ("l", None, "")]
    df = spark.createDataFrame(data + data[:2], "candidate_id string, payload_json string, digest string")
    assert rows(formatdup.copy_pairs(df)) == [("a", "b"), ("a", "c"), ("a", "j"), ("f", "g"), ("h", "i")]
    assert dict(rows(formatdup.collapsed(df))) == {"a": 4, "d": 1, "e": 1, "f": 2, "h": 2, "k": 1, "l": 1}
    assert formatdup.copies(df).count() == 12 and formatdup.copies(df.limit(0)).count() == 0


def test_records_that_share_a_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(formatdup, "merkle", lambda value: b"same digest 1234")
    monkeypatch.setattr(formatdup, "PART_ROWS", 3)
    texts = ["one", "two", "ONE!", "three", "Two.", "t w o", "one"] * 3
    df = spark.createDataFrame([(f"k{i:02}", json.dumps({"conversations": [{"role": "user", "content": t}]})) for i, t in enumerate(texts)] + [("k99", None)], "candidate_id string, payload_json string")
    assert dict(rows(formatdup.collapsed(df))) == {"k00": 9, "k01": 9, "k03": 3, "k99": 1}
    assert len(rows(formatdup.copy_pairs(df))) == 8 + 8 + 2


def test_a_hot_class_is_compared_in_parts(spark):
    payload = json.dumps({"conversations": [{"role": "user", "content": "Hot"}]})
    df = spark.range(5000).select(F.format_string("k%05d", "id").alias("candidate_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit(payload), F.repeat(F.lit(" "), (F.col("id") % 7).cast("int")))).otherwise(F.concat(F.lit('{"conversations":[{"content":"'), F.col("id").cast("string"), F.lit('"}]}'))).alias("payload_json"))
    got = formatdup.collapsed(df)
    assert got.count() == 1 + 1667 and got.filter("copies > 1").collect()[0][:] == ("k00001", 3333)


def test_field_order_is_no_difference_but_message_order_is():
    a, b = [{"role": "x", "content": "1"}], [{"content": "1", "role": "x"}]
    assert formatdup.merkle(a) == formatdup.merkle(b)
    assert formatdup.merkle(a + [{"role": "y"}]) != formatdup.merkle([{"role": "y"}] + a)


# ---- leakage


def _leaks_by_force(docs, items):
    out = set()
    for i, p in items:
        f = letters_digits(p, nfkc=True)
        need = (len(f) + 1) // 2
        for d, t in docs:
            n = letters_digits(t, nfkc=True)
            if f and any(f[k : k + need] in n for k in range(len(f) - need + 1)):
                out.add((i, d))
    return sorted(out)


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 12)))) for i in range(40)] + [(90, "Ｆｕｌｌ width TEXT"), (91, "full WIDTH text"), (92, "?!"), (93, None)]
    docs = [(d, " ".join(word() for _ in range(rng.randint(0, 60)))) for d in range(60)] + [(100, "A full--width te xt."), (101, None), (102, "")]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:3], "item_id long, normalized_prompt string"))
    assert sorted({(r.item_id, r.doc_id) for r in got.collect()}) == _leaks_by_force([d for d in docs if d[1]], [i for i in items if i[1]])
    assert all(2 * r.run_chars >= r.item_chars for r in got.collect())


def test_leaked_spans_and_documents_are_removed(spark):
    docs = spark.createDataFrame([(1, "Start. The Quick, brown FOX jumps! End."), (2, "clean"), (3, None)], "doc_id long, text string")
    found = leakage.leaks(docs, spark.createDataFrame([(5, "the quick brown fox jumps")], "item_id long, normalized_prompt string"))
    assert rows(leakage.without_leaks(docs, found).filter("text is not null")) == [(1, "Start. ! End.", 26, 1), (2, "clean", 0, 0)]
    assert rows(leakage.without_leaks(docs, found, mode="document").select("doc_id")) == [(2,), (3,)]


def test_every_occurrence_of_a_leaked_item_is_removed(spark, tmp_path):
    item = "the quick brown fox jumps"
    texts = [f"A. {item} B. {item.upper()}! C.", "A. the quick brown B. brown fox jumps C.", "A. the quick bro B. " + item + " C.", "9 " + "ab" * 40 + " 9", "clean", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(5, item), (6, "ab" * 10)], "item_id long, normalized_prompt string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "eval_reference.parquet"))
    got = {r.doc_id: r for r in queries.p7_clean(spark, str(tmp_path)).collect()}
    assert [got[i].text for i in range(6)] == ["A.  B. ! C.", "A.  B.  C.", "A.  B.  C.", "9  9", "clean", None]
    assert [got[i].leaked_items for i in range(5)] == [1, 1, 1, 1, 0]
    assert leakage.leaks(docs, items).count() == 4


def test_places_of_the_normal_form_are_exact():
    rng = random.Random(6)
    parts = [*"aZ9 ,.-_éñßİǆ", "e\u0301", "\u0301", "\u0327\u0301", "ｶﾞ", "ﾊﾟ", "か\u3099", "\u1112\u1161\u11ab", "\u1161", "한", "ﬃ", "ﷺ", "①", "½", "Å", "\u0345", "ᾳ", "ग\u093c", "\u0dd9\u0dcf", "👍🏽", "\ud800", "㌔"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        form, starts, ends = leakage._segments(t)
        assert form == letters_digits(t, nfkc=True) and len(form) == len(starts) == len(ends)
        for a in {0, *starts.tolist()}:
            assert letters_digits(t[:a], nfkc=True) + letters_digits(t[a:], nfkc=True) == form


def test_removal_takes_the_spans_and_nothing_else(spark):
    item = "closed towers keep ice on their stairs"
    for odd in ("ｶﾞ", "한\u1100\u1161\u11a8", "ﬃ ﷺ", "e\u0301 ½"):
        text = f"{odd * 300} {item.upper()} {odd * 40} {item}! {odd}"
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        items = spark.createDataFrame([(5, item)], "item_id long, normalized_prompt string")
        got = leakage.without_leaks(docs, leakage.leaked_runs(docs, items))
        assert rows(got) == [(1, f"{odd * 300}  {odd * 40} ! {odd}", 2 * len(item), 1)]
        assert leakage.leaks(got, items).count() == 0


def test_a_periodic_item_in_a_periodic_text():
    known = leakage.NgramSet([(1, "ab" * 400), (2, "a" * 30)])
    got = {(r, k): n for r, k, _, _, n in known.scan(["ab" * 20_000, "a" * 14, "a" * 15, "x" + "ab" * 200])}
    assert got == {(0, 0): 800, (2, 1): 15, (3, 0): 400}


def test_what_is_left_holds_no_run_of_an_item(spark):
    rng = random.Random(9)
    items = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(8, 24)))) for i in range(6)]
    docs = [(d, "-".join(rng.choice(items)[1][rng.randint(0, 4) :] + "x" * rng.randint(0, 3) for _ in range(8))) for d in range(40)]
    found = leakage.leaked_runs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, normalized_prompt string"))
    covered: dict = {}
    for r in found.collect():
        covered.setdefault((r.item_id, r.doc_id), set()).update(range(r.doc_start, r.doc_start + r.run_chars))
    for i, p in items:
        need = (len(p) + 1) // 2
        for d, t in docs:
            form = letters_digits(t, nfkc=True)
            want = {c for k in range(len(form) - need + 1) if form[k : k + need] in p for c in range(k, k + need)}
            assert covered.get((i, d), set()) == want


# ---- shared spans


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = [letters(n) for n in (199, 200, 260, 450)]
    docs = [letters(rng.randint(0, 400)) + c + letters(rng.randint(0, 300)) for c in common for _ in range(3)] + ["ab" * 400, "ab" * 101, "x" * 5000, "x" * 200 + "y", "ba" * 99 + "z", letters(300), "", None]
    docs += [docs[4], docs[4], common[3][:220] + letters(50)]
    seen: dict[str, set[int]] = {}
    for i, t in enumerate(docs):
        for k in range(len(t or "") - 199):
            seen.setdefault(t[k : k + 200], set()).add(i)
    want = sorted({(a, b) for ids in seen.values() for a in ids for b in ids if a < b})
    df = spark.createDataFrame([(i, t, "d") for i, t in enumerate(docs)], "doc_id long, text string, digest string")
    assert rows(spans.shared_pairs(df)) == want
    share = {r.doc_id: r.shared_chars for r in spans.shared_share(df).collect()}
    for i, t in enumerate(docs):
        if t:
            covered = {c for k in range(len(t) - 199) if len(seen[t[k : k + 200]]) > 1 for c in range(k, k + 200)}
            assert share[i] == len(covered), i
    assert spans.shared_pairs(df.limit(0)).count() == 0


def test_a_passage_of_many_texts_costs_a_link_each(spark):
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot, tail = letters(400), letters(230)
    docs = [letters(rng.randint(0, 150)) + hot[rng.choice([0, 0, 0, 60, 150]) :] + rng.choice(["", "", tail]) + letters(rng.randint(0, 150)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows_ = spans._texts(df, "doc_id", "text", 200)
    links = spans._first_pairs(rows_, spans._anchors(rows_, 200), 200).count()
    assert 299 <= links <= 8 * 300, links
    count: dict[str, set[int]] = {}
    for i, t in enumerate(docs):
        for k in range(len(t) - 199):
            count.setdefault(t[k : k + 200], set()).add(i)
    share = {r.doc_id: r.shared_chars for r in spans.shared_share(df).collect()}
    for i, t in enumerate(docs):
        assert share[i] == len({c for k in range(len(t) - 199) if len(count[t[k : k + 200]]) > 1 for c in range(k, k + 200)}), i


def test_short_spans(spark):
    rng = random.Random(31)
    docs = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for length in (2, 5, 12):
        runs = [{t[k : k + length] for k in range(len(t) - length + 1)} for t in docs]
        want = sorted((i, j) for i in range(40) for j in range(i + 1, 40) if runs[i] & runs[j])
        assert rows(spans.shared_pairs(df, length=length)) == want, length


def test_parse_finds_spans_that_factors_part():
    a, b, c = ("".join(random.Random(k).choice("abcdef") for _ in range(150)) for k in (1, 2, 3))
    ref = a + b + "|" + b + c * 2
    assert max(n for _, _, n in spans.factors(spans.Block(ref), "zz" + a + b + "yy", 200)) == 300


def _covered(ref, t, length):
    """Characters of t in runs of ``length`` that stand in ref."""
    return {c for k in range(len(t) - length + 1) if t[k : k + length] in ref for c in range(k, k + length)}


def test_parse_loses_nothing_in_long_periodic_texts():
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, c, other = letters(20), letters(60), letters(90)
    cases = [(a + c + "-" * 70 + "Q" + other + c + "-" * 150 + "Z", a + c + "-" * 160 + "W")]
    for _ in range(1500):
        unit = rng.choice(["-", "-", "ab", "- =", "x" * 7 + "y", "".join(rng.choice("ab") for _ in range(rng.randint(2, 40)))])
        tails = [letters(rng.randint(1, 90)) for _ in range(3)]

        def text(unit=unit, tails=tails):
            parts = []
            for _ in range(rng.randint(1, 4)):
                n = rng.choice([70, 130, 150, 160, 200, 210, 260, rng.randint(1, 400)])
                at = rng.randint(0, len(unit) - 1)
                parts += [rng.choice([*tails, "", "Q"]), (unit * 400)[at : at + n], rng.choice(["", "", unit[:1], "Z"])]
            return "".join(parts) + rng.choice([*tails, ""])

        cases.append((text(), text()))
    periodic = 0
    for ref, t in cases:
        block = spans.Block(ref)
        periodic += len(block.hashes) - len(set(block.hashes.tolist())) > 64
        got = spans.factors(block, t, 200)
        assert all(ref[j : j + n] == t[i : i + n] and n >= 200 for j, i, n in got)
        assert {x for _, i, n in got for x in range(i, i + n)} == _covered(ref, t, 200), (ref, t)
    assert periodic > 1000


# ---- overlaps


def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(3, 150))) for _ in range(25)]
    prompts = base + [p[: rng.randint(1, len(p))] + rng.choice(["", "q", "qq"]) + p[rng.randint(1, len(p)) :] for p in base for _ in range(4)] + ["abcd", "abcd", "abcde", None]
    splits = [rng.choice([" Train", "train", "TEST ", "validation", "other"]) for _ in prompts]
    data = [(f"id{i}", f"src{i % 3}:{i}", s, p) for i, (s, p) in enumerate(zip(splits, prompts))]
    df = spark.createDataFrame(data + data[:10], "candidate_id string, origin_group_id string, split string, prompt_norm string")
    want = set()
    gram = lambda t: {t[k : k + 5] for k in range(len(t) - 4)}
    for i, _, s, p in data:
        for j, _, u, q in data:
            if s.strip().lower() in ("test", "validation") and u.strip().lower() == "train" and p is not None and q is not None:
                x, y = gram(p), gram(q)
                if p == q or (x | y and 10 * len(x & y) >= 8 * len(x | y)):
                    want.add(tuple(sorted((i, j))))
    got = {(r.key_a, r.key_b) for r in overlap.candidate_overlaps(df).collect()}
    assert got == want and want
    assert overlap.candidate_overlaps(df.limit(0)).count() == 0


def test_chunk_overlaps(spark):
    chunk = "digest binary, token_count long, first_shard string, first_line long"
    a = spark.createDataFrame([(b"1", 5, "t", 1), (b"2", 5, "t", 2), (None, 5, "t", 3)], chunk)
    b = spark.createDataFrame([(b"1", 6, "v", 9), (b"1", 7, "v", 9), (None, 5, "v", 3)], chunk)
    assert rows(overlap.chunk_overlaps(a, b)) == [("t:1", "v:9", "v:9")]


def test_weighted_join_loses_no_pair(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(12)) for _ in range(60)]
    df = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "key long, side int, text string")
    got = {(r.key_0, r.key_1) for r in overlap.cosine_candidates(df, 0.9, scheme="idf").collect()}
    both = {t: set(t[k : k + 5] for k in range(len(t) - 4)) for t in texts}
    same = {(i, j) for i in range(0, 60, 2) for j in range(1, 60, 2) if both[texts[i]] == both[texts[j]]}
    assert same <= got


def test_weighted_products_are_exact(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_LIST", 7)  # lists of most terms are split
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"] + [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    texts += [t + rng.choice(["", " end", "s"]) for t in texts for _ in range(2)] + ["", "abc"]
    df = spark.createDataFrame([(bytes([i % 200, i // 200]), i % 2, t) for i, t in enumerate(texts)], "digest binary, side int, text string")
    gram = lambda t: {t[k : k + 5] for k in range(len(t) - 4)}
    for scheme in ("idf", "uniform"):
        terms = overlap._fit(df, 5, scheme)
        vectors = []
        for t in texts:
            h, _, _, w = overlap._vectors([t], 5, terms, scheme)
            vectors.append(dict(zip(h.tolist(), w.tolist())))
        want = {}
        for i in range(0, len(texts), 2):
            for j in range(1, len(texts), 2):
                product = sum(w * vectors[j].get(h, 0.0) for h, w in vectors[i].items())
                if product >= 0.7:
                    want[i, j] = (round(product, 6), len(gram(texts[i]) & gram(texts[j])))
        at = lambda d: d[0] + 200 * d[1]
        got = {(at(r.digest_0), at(r.digest_1)): (round(r.product, 6), r.shared) for r in overlap.cosine_join(df, 0.7, 5, scheme).collect()}
        assert got == want and len(want) > 20


def test_links_and_members_give_the_pairs(spark):
    rng = random.Random(12)
    prompts = [f"question {i % 9} about the {'long ' * (i % 4)}river and the tower" for i in range(60)]
    data = [(f"id{i:02}", "s:1", rng.choice(["train", "test"]), p) for i, p in enumerate(prompts)]
    df = spark.createDataFrame(data, "candidate_id string, origin_group_id string, split string, prompt_norm string")
    of: dict = {}
    for r in overlap.prompt_members(df).collect():
        of.setdefault((r.side, r.first), []).append(r.candidate_id)
    pairs = {tuple(sorted((a, b))) for r in overlap.linked_prompts(df).collect() for a in of["held", r.held_first] for b in of["train", r.train_first]}
    assert pairs == {(r.key_a, r.key_b) for r in overlap.candidate_overlaps(df).collect()} and pairs


# ---- packing


def test_sum_of_squares_keeps_the_capacity():
    rng = random.Random(4)
    sizes = [rng.randint(1, 60) for _ in range(3000)]  # sizes well below the capacity pack with bounded waste
    load: dict[int, int] = {}
    for s, k in zip(sizes, packing.sum_of_squares(sizes, 100)):
        load[k] = load.get(k, 0) + s
    assert max(load.values()) <= 100 and len(load) <= 1.02 * sum(sizes) / 100 + 1
    assert packing.sum_of_squares([100, 100], 100) == [0, 1] and packing.sum_of_squares([], 10) == [] and packing.sum_of_squares([5, 5, 5], 10) == [0, 0, 1]


def test_every_token_is_packed_once(spark):
    sizes = [(i, (i * 37) % 2000) for i in range(300)] + [(7, (7 * 37) % 2000), (900, None), (None, 5)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    for group in (15, 150, 100_000):  # 20 groups, 2 groups, 1 group
        got = packing.pack_sizes(df, 768, group)
        parts = got.select("sequence_id", "used", F.explode("documents").alias("d")).select("sequence_id", "used", "d.*").collect()
        total: dict[int, int] = {}
        for p in parts:
            total[p.doc_id] = total.get(p.doc_id, 0) + p.n_tokens
        assert total == {i: n for i, n in sizes[:300] if n}
        assert got.filter("used > 768").count() == 0 and got.select("sequence_id").distinct().count() == got.count()
        assert all(sum(p.doc_id == i for p in parts) == -(-n // 768) for i, n in sizes[:300] if n)
    assert packing.pack_sizes(df.limit(0)).count() == 0


def test_groups_cost_little_room(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(400)) + 20).alias("n_tokens"))
    filled = [packing.fill(packing.pack_sizes(df, 768, group)).first() for group in (1_000, 10_000, 50_000)]
    assert all(r.least_sequences <= r.sequences and r.filled > 0.99 for r in filled), filled


def test_tokens_of_a_public_tokenizer(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string")
    got = dict(rows(packing.token_sizes(df)))
    with open(packing.default_tokenizer()[0], "rb") as f:
        encoding = packing._encoding(f.read(), packing.default_tokenizer()[1])
    assert got == {1: len(encoding.encode_ordinary("hello world")), 4: len(encoding.encode_ordinary("<|endoftext|>"))} and got[4] > 1


# ---- mixing


def test_shares_and_repeats(spark):
    units = [("source", "big", f"b{i}", 10, 1.0) for i in range(900)] + [("source", "small", f"s{i}", 10, 0.1 + i / 100) for i in range(50)] + [("source", "small", "s0", 10, 0.1), ("source", None, "x", 1, 1.0), ("source", "big", "neg", -5, 1.0)]
    df = spark.createDataFrame(units, "unit_kind string, unit_id string, record_key string, size long, weight double")
    targets = spark.createDataFrame([("m", "source", "Big", 0.7, 1), ("m", "source", "small", 0.2, 3), ("m", "source", "none", 0.1, 2)], "mix_id string, unit_kind string, unit_id string, target_share double, max_repeats int")
    got = {r.unit_id: r for r in mixing.shares(df, targets).collect()}
    assert got["small"].most_uses == 3 and got["none"].actual_size == 0
    assert abs(got["big"].actual_size / got["small"].actual_size - 3.5) < 0.05
    uses = mixing.uses(df, targets).collect()
    assert {r.uses for r in uses if r.unit_id == "small"} == {3} and {r.uses for r in uses if r.unit_id == "big"} == {0, 1}
    capped = {r.unit_id: r for r in mixing.shares(df, targets, total_size=20_000).collect()}
    assert capped["small"].actual_size == 1500 and capped["big"].actual_size == 9000
    part = mixing.uses(df, targets, total_size=1000).filter("unit_id = 'small'").agg(F.sum(F.col("uses") * F.col("size"))).first()[0]
    assert part == 200
    assert mixing.uses(df.limit(0), targets).count() == 0
    left = {r.unit_id: r for r in mixing.shares(df, targets, total_size=1000).collect()}
    assert left["small"].available_size == 500 and left["small"].unused_size == 300 and left["none"].unused_size == 0


def test_shares_miss_by_less_than_a_record(spark):
    rng = random.Random(3)
    units = [("source", f"u{k % 3}", f"r{k}", rng.randint(1, 50), rng.random()) for k in range(3000)]
    df = spark.createDataFrame(units, "unit_kind string, unit_id string, record_key string, size long, weight double")
    targets = spark.createDataFrame([("m", "source", "u0", 0.61, 4), ("m", "source", "u1", 0.29, 4), ("m", "source", "u2", 0.1, 4)], "mix_id string, unit_kind string, unit_id string, target_share double, max_repeats int")
    for total in (5_000, 40_000, 100_000):
        for r in mixing.shares(df, targets, total_size=total).collect():
            want = min(int(total * r.target_share + 1e-6), 4 * r.available_size)
            assert want - 50 < r.actual_size <= want and r.most_uses <= 4, r


def test_quality_tells_prose_from_noise(spark):
    prose = "The miller opens the gate at dawn, and the river turns the old wheel until evening falls over the valley. " * 2 + "Nobody in the village remembers a summer without that sound."
    texts = [prose, "buy now " * 40, "| 1 | 2 |\n" * 40, "!!! ??? ---- " * 30, "ok", "", None, "河水推动旧水车从清晨转到傍晚村里没有人记得没有那种声音的夏天人们在桥边等着磨坊主打开大门然后把谷子搬进去" * 4]
    got = [r.w for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(mixing.text_quality(F.col("t")).alias("w")).collect()]
    assert got[0] > 0.8 and all(w < 0.65 for w in got[1:7]) and got[7] > 0.7 and got[5] == got[6] == mixing.LEAST_WEIGHT, got


def test_heavier_records_come_first(spark):
    df = spark.range(4000).select(F.lit("source").alias("unit_kind"), F.lit("u").alias("unit_id"), F.col("id").cast("string").alias("record_key"), F.lit(1).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("weight"))
    targets = spark.createDataFrame([("m", "source", "u", 1.0, 1)], "mix_id string, unit_kind string, unit_id string, target_share double, max_repeats int")
    got = mixing.uses(df, targets, total_size=1000).filter("uses = 1").select((F.col("record_key").cast("int") % 2).alias("odd")).groupBy("odd").count().collect()
    share = {r.odd: r["count"] for r in got}
    assert share[0] + share[1] == 1000 and 700 < share[0] < 880
