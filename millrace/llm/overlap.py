"""Same and near-same records across splits: exact digests and a weighted cosine join.

Texts are unit vectors over their character n-grams. Terms are put in one global
order (rare first, from counts over all texts) and only the start of each
vector goes into the inverted lists: up to where neither the norm of the rest
(Cauchy-Schwarz) nor its dot product with the largest weights the other split
has for those terms can reach the threshold. Two vectors that reach it share a
listed term, so no pair is lost; candidates are settled by exact dot products.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_columns
from ..functions.unicode import chunks, distinct_grams, mixed
from ..runtime import written

#: Terms share this many counters; a fixed 12 bytes each are broadcast, whatever the data.
COUNTERS = 1 << 19
#: 64-bit words of a parity sketch.
SKETCH_WORDS = 4
#: Texts that list a term in one part; the lists of more frequent terms are split.
HOT_LIST = 100_000
_SHIFT = np.uint64(64 - 19)


def split_name(column: str) -> Column:
    """``train``, ``validation`` or ``test`` however it is written."""
    return F.lower(F.regexp_replace(F.col(column), r"(?U)\s+", ""))


def _weights(counts: np.ndarray, total: int, scheme: str) -> np.ndarray:
    if scheme == "uniform":
        return np.ones(len(counts))
    return np.log1p(total / np.maximum(counts, 1))


class Terms:
    """Counts of all terms and the largest weight each split has for them, in shared counters."""

    def __init__(self, counts: np.ndarray, largest: np.ndarray, total: int, scheme: str):
        self.counts, self.largest, self.total, self.scheme = counts, largest, total, scheme


def _vectors(texts: list[str], width: int, terms: Terms | None, scheme: str):
    """Row offsets, terms and normalised weights of each text."""
    hashes, owner = distinct_grams(texts, width)
    slot = (hashes >> _SHIFT).astype(np.int64)
    raw = _weights(terms.counts[slot], terms.total, scheme) if terms is not None and scheme != "uniform" else np.ones(len(hashes))
    norm = np.sqrt(np.bincount(owner, weights=raw * raw, minlength=len(texts)))
    return hashes, owner, slot, raw / np.maximum(norm[owner], 1e-300) if len(raw) else raw


def _fit(sides: DataFrame, width: int, scheme: str) -> Terms:
    """Count the terms over all texts, then (for the bounds) the largest weight of each in either split."""

    def run(terms: Terms | None):
        def count(side: list, texts: list) -> dict:
            out: dict = {"slot": [], "n": [], "w0": [], "w1": []}
            sides = np.array(side)
            n = np.zeros(COUNTERS, dtype=np.int64)
            w = np.zeros((2, COUNTERS))
            for a, b in chunks(texts):
                _, owner, slot, weight = _vectors(texts[a:b], width, terms, scheme)
                n += np.bincount(slot, minlength=COUNTERS)
                which = sides[a:b][owner]
                for k in (0, 1):
                    np.maximum.at(w[k], slot[which == k], weight[which == k])
            seen = np.flatnonzero(n)
            return {"slot": seen, "n": n[seen], "w0": w[0][seen], "w1": w[1][seen]}

        return count

    def gather(terms: Terms | None) -> Terms:
        counts, largest = np.zeros(COUNTERS, dtype=np.int64), np.zeros((2, COUNTERS), dtype=np.float32)
        found = map_columns(sides.select("side", "text"), run(terms), "slot long, n long, w0 double, w1 double")
        # at most COUNTERS rows, however many texts there are
        table = found.groupBy("slot").agg(F.sum("n").alias("n"), F.max("w0").alias("w0"), F.max("w1").alias("w1")).toArrow()
        slot = table["slot"].to_numpy()
        counts[slot] = table["n"].to_numpy()
        for k in (0, 1):
            largest[k, slot] = np.nextafter(table[f"w{k}"].to_numpy().astype(np.float32), np.float32(2))
        return Terms(counts, largest, total, scheme)

    total = sides.count() if scheme != "uniform" else 0
    fitted = gather(None)
    return fitted if scheme == "uniform" else gather(fitted)


def cosine_candidates(sides: DataFrame, threshold: float, width: int = 5, scheme: str = "uniform", jaccard: float | None = None, fitted: Broadcast | None = None) -> DataFrame:
    """``(key_0, key_1)`` of texts from side 0 and side 1 whose cosine may reach the threshold; none that does is missing.

    ``sides`` has a 64-bit ``key``, ``side`` (0 or 1) and ``text``; should two
    texts share a key, the pair stands for both. A pair is met at each listed
    term the two share. At the first of them nothing precedes, so what follows
    in either vector bounds the whole product; such meetings that can't reach
    the threshold are dropped before anything is shuffled, and the pairs that
    are left are bounded once more by what they share so far and what follows
    the last meeting. With ``jaccard`` (equal weights only) both bounds also
    count common terms against the overlap that the two sizes need.
    """
    shared = fitted or sides.sparkSession.sparkContext.broadcast(_fit(sides, width, scheme))

    def post(keys: list, side: list, texts: list) -> dict:
        terms = shared.value
        out: dict = {name: [] for name in ("term", "salt", "key", "side", "size", "weight", "rest")}
        keys_, sides_ = np.array(keys, dtype=np.int64), np.array(side)
        for a, b in chunks(texts):
            hashes, owner, slot, weight = _vectors(texts[a:b], width, terms, scheme)
            order = np.lexsort((hashes, terms.counts[slot], owner))
            hashes, owner, slot, weight = hashes[order], owner[order], slot[order], weight[order]
            theirs = terms.largest[1 - sides_[a:b][owner], slot].astype(np.float64)
            size = np.bincount(owner, minlength=b - a)
            start = np.concatenate([[0], np.cumsum(size)])[owner]
            square, product = np.concatenate([[0], np.cumsum(weight * weight)]), np.concatenate([[0], np.cumsum(weight * theirs)])
            at, end = np.arange(len(hashes)), start + size[owner]
            rest = np.sqrt(np.maximum(square[end] - square[at], 0))  # norm from here on
            bound = np.minimum(rest, product[end] - product[at])
            keep = np.flatnonzero((bound >= threshold - 1e-6) & (theirs > 0))
            # the list of a hot term is split: side 1 by text, and each text of side 0 goes to all its parts
            parts = terms.counts[slot[keep]] // HOT_LIST + 1
            spread = np.where(sides_[a:b][owner[keep]] == 0, parts, 1)
            keep, parts = np.repeat(keep, spread), np.repeat(parts, spread)
            turn = np.arange(len(keep)) - np.repeat(np.cumsum(spread) - spread, spread)
            own = (mixed(keys_[a:b][owner[keep]].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
            out["salt"].append(np.where(sides_[a:b][owner[keep]] == 0, turn, own).astype(np.int32))
            out["term"].append(hashes[keep].view(np.int64))
            out["weight"].append(weight[keep].astype(np.float32))
            out["rest"].append(rest[keep].astype(np.float32))
            out["size"].append(size[owner[keep]])
            out["key"].append(keys_[a:b][owner[keep]])
            out["side"].append(sides_[a:b][owner[keep]])
        return {k: np.concatenate(v) for k, v in out.items()}

    posted = map_columns(sides.select("key", "side", "text"), post, "term long, salt int, key long, side int, size int, weight float, rest float")
    a, b = (posted.filter(F.col("side") == k).select("term", "salt", F.col("key").alias(f"key_{k}"), F.col("size").alias(f"n{k}"), F.col("weight").cast("float").alias(f"w{k}"), F.col("rest").alias(f"r{k}")) for k in (0, 1))
    squares = [F.col(f"r{k}").cast("double") * F.col(f"r{k}") for k in (0, 1)]
    met = a.join(b, ["term", "salt"]).filter(F.sqrt(squares[0] * squares[1]) >= threshold - 1e-5)
    after = [F.greatest(squares[k] - F.col(f"w{k}").cast("double") * F.col(f"w{k}"), F.lit(0.0)) for k in (0, 1)]
    met = met.withColumn("product", F.col("w0").cast("double") * F.col("w1")).withColumn("beyond", F.sqrt(after[0] * after[1]))
    if jaccard is None:
        pairs = met.groupBy("key_0", "key_1").agg(F.sum("product").alias("product"), F.min("beyond").alias("beyond"))
        return pairs.filter(F.col("product") + F.col("beyond") >= threshold - 1e-4).select("key_0", "key_1")
    need = F.ceil(jaccard / (1 + jaccard) * (F.col("n0") + F.col("n1")) - 1e-6).cast("int")
    left = F.least(F.round(squares[0] * F.col("n0")), F.round(squares[1] * F.col("n1"))).cast("int")  # terms from this one on
    met = met.select("key_0", "key_1", need.alias("need"), left.alias("left")).filter("left >= need")
    pairs = met.groupBy("key_0", "key_1", "need").agg(F.count(F.lit(1)).alias("common"), F.min("left").alias("left"))
    return pairs.filter("common + left - 1 >= need").select("key_0", "key_1").distinct()


def _parity(keyed: DataFrame, near: DataFrame, threshold: float, width: int) -> DataFrame:
    """Drop candidate pairs whose parity sketches differ in more bits than sets that similar can: each term flips a bit."""

    def sketch(keys: list, texts: list) -> dict:
        words = np.zeros((len(texts), SKETCH_WORDS * 64), dtype=np.int64)
        size = np.zeros(len(texts), dtype=np.int64)
        for a, b in chunks(texts):
            hashes, owner = distinct_grams(texts[a:b], width)
            size[a:b] = np.bincount(owner, minlength=b - a)
            np.add.at(words, (owner + a, (hashes % np.uint64(SKETCH_WORDS * 64)).astype(np.int64)), 1)
        bits = np.packbits((words & 1).astype(np.uint8), axis=1).view(np.int64)
        return {"key": keys, "n": size} | {f"b{i}": bits[:, i] for i in range(SKETCH_WORDS)}

    fields = "key long, n long, " + ", ".join(f"b{i} long" for i in range(SKETCH_WORDS))
    for k in (0, 1):
        bits = map_columns(keyed.filter(F.col("side") == k).select("key", "text"), sketch, fields)
        near = near.join(bits.select(*(F.col(c).alias(f"{c}_{k}") for c in bits.columns)), f"key_{k}")
    differ = sum((F.bit_count(F.col(f"b{i}_0").bitwiseXOR(F.col(f"b{i}_1"))) for i in range(SKETCH_WORDS)), F.lit(0))
    return near.filter(differ <= (1 - threshold) / (1 + threshold) * (F.col("n_0") + F.col("n_1")) + 1e-6).select("key_0", "key_1").distinct()


def cosine_join(sides: DataFrame, threshold: float, width: int = 5, scheme: str = "idf", jaccard: float | None = None) -> DataFrame:
    """``(digest_0, digest_1, product, shared, size_0, size_1)``: every two texts of either side whose vectors' dot product reaches the threshold.

    ``sides`` has ``digest``, ``side`` and ``text``, each text once a side. The
    product is exact: the vectors of both texts are made again and multiplied
    term by term. ``shared`` and the sizes count distinct terms. With ``scheme``
    "idf" a term weighs the logarithm of how rare it is among all texts, with
    "uniform" all weigh the same. Texts shorter than ``width`` have no terms and
    match nothing. With ``jaccard`` (equal weights only) the pairs are those whose
    sets have at least that share of their union in common.
    """
    keyed = sides.select("digest", "side", "text", F.xxhash64("digest").alias("key"))
    fitted = sides.sparkSession.sparkContext.broadcast(_fit(keyed, width, scheme))
    near = cosine_candidates(keyed, threshold, width, scheme, jaccard, fitted)
    if jaccard is not None:
        near = _parity(keyed, near, jaccard, width)
    for k in (0, 1):
        near = near.join(keyed.filter(F.col("side") == k).select(F.col("key").alias(f"key_{k}"), F.col("digest").alias(f"digest_{k}"), F.col("text").alias(f"text_{k}")), f"key_{k}")
    per_mille = round(jaccard * 1000) if jaccard is not None else 0

    def multiply(k0: list, t0: list, k1: list, t1: list) -> dict:
        out: dict = {name: [] for name in ("digest_0", "digest_1", "product", "shared", "size_0", "size_1")}
        for a, b in chunks([x + y for x, y in zip(t0, t1)]):
            vectors = []
            for texts in (t0[a:b], t1[a:b]):
                hashes, owner, _, weight = _vectors(texts, width, fitted.value, scheme)
                edges = np.searchsorted(owner, np.arange(len(texts) + 1))
                vectors.append((hashes, weight, edges))
            (h0, w0, e0), (h1, w1, e1) = vectors
            for i in range(b - a):
                x, y = slice(e0[i], e0[i + 1]), slice(e1[i], e1[i + 1])
                _, at, bt = np.intersect1d(h0[x], h1[y], assume_unique=True, return_indices=True)
                product, both, m, n = float(w0[x][at] @ w1[y][bt]), len(at), e0[i + 1] - e0[i], e1[i + 1] - e1[i]
                if product >= threshold - 1e-9 and both * 1000 >= per_mille * (m + n - both) and both:
                    for name, value in zip(out, (k0[a + i], k1[a + i], product, both, m, n)):
                        out[name].append(value)
        return out

    return map_columns(near.select("digest_0", "text_0", "digest_1", "text_1"), multiply, "digest_0 binary, digest_1 binary, product double, shared long, size_0 long, size_1 long")


def jaccard_pairs(sides: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """``(digest_0, digest_1, product, shared, size_0, size_1)`` of the texts whose sets of n-grams have at least ``threshold`` of their union in common.

    For sets as unit vectors of equal weights a Jaccard of t is a cosine of at
    least 2t / (1 + t), so this is :func:`cosine_join` with that threshold, and
    the sets compared in whole numbers once the dot product is known.
    """
    return cosine_join(sides, 2 * threshold / (1 + threshold), width, "uniform", threshold)


def chunk_overlaps(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """``(key_a, key_b, held_key)``: rows of the two chunk tables with equal digest; keys are shard:line, key_a < key_b.

    The smaller side is broadcast only if the planner's size limit allows it. Null digests match nothing.
    """
    key = F.concat_ws(":", "first_shard", F.col("first_line").cast("string"))
    a = train.filter("digest is not null").select("digest", key.alias("t")).distinct()
    b = held_out.filter("digest is not null").select("digest", key.alias("v")).distinct()
    both = a.join(b, "digest").filter("t <> v")
    return both.select(F.least("t", "v").alias("key_a"), F.greatest("t", "v").alias("key_b"), F.col("v").alias("held_key")).distinct()


def _candidate_sides(candidates: DataFrame) -> DataFrame:
    split = split_name("split")
    side = F.when(split == "train", 1).when(split.isin("validation", "test"), 0)
    rows = candidates.select(F.col("candidate_id").cast("string").alias("id"), side.alias("side"), split.alias("split"), F.split("origin_group_id", ":")[0].alias("source"), F.col("prompt_norm").alias("text"))
    return rows.filter("id is not null and side is not null and text is not null").withColumn("digest", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def prompt_links(candidates: DataFrame, threshold: float = 0.8, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Pairs of distinct prompts ``(digest_0, digest_1)``, held-out and train, that are equal or nearly so; and who has which prompt.

    The second frame is ``(digest, side, id, split, source)``. Equal prompts are
    collapsed before the join (by a 128-bit digest of the text), so that copies
    cost one vector a side; expanding them is left to whoever needs it.
    """
    rows = _candidate_sides(candidates)
    prompts = written(rows.select("digest", "side", "text").dropDuplicates(["digest", "side"]))
    of = written(rows.select("digest", "side", "id", "split", "source").dropDuplicates(["digest", "side", "id", "split", "source"]))
    near = jaccard_pairs(prompts, threshold, width).select("digest_0", "digest_1")
    equal = prompts.groupBy("digest").agg(F.countDistinct("side").alias("n")).filter("n = 2").select(F.col("digest").alias("digest_0"), F.col("digest").alias("digest_1"))
    return near.unionByName(equal).distinct(), of


def candidate_overlaps(candidates: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """``(key_a, key_b, held_key, held_split, held_source)``: held-out and train records with equal or nearly equal prompts.

    Rows delivered twice count once; other splits, null prompts and null ids take
    no part. A record that names several sources is listed under each.
    """
    pairs, of = prompt_links(candidates, threshold, width)
    held = of.filter("side = 0").select(F.col("digest").alias("digest_0"), F.col("id").alias("h"), F.col("split").alias("held_split"), F.col("source").alias("held_source"))
    train = of.filter("side = 1").select(F.col("digest").alias("digest_1"), F.col("id").alias("t")).distinct()
    found = pairs.join(held, "digest_0").join(train, "digest_1").filter("h <> t")
    return found.select(F.least("h", "t").alias("key_a"), F.greatest("h", "t").alias("key_b"), F.col("h").alias("held_key"), "held_split", "held_source").distinct()


def linked_prompts(candidates: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """``(held_first, train_first, held_records, train_records)``: one row for each two overlapping prompts.

    Prompts are named by the smallest candidate_id that has them; with
    :func:`prompt_members` that is the same as all pairs, without their number.
    """
    pairs, of = prompt_links(candidates, threshold, width)
    for k, name in ((0, "held"), (1, "train")):
        who = of.filter(F.col("side") == k).groupBy(F.col("digest").alias(f"digest_{k}")).agg(F.min("id").alias(f"{name}_first"), F.countDistinct("id").alias(f"{name}_records"))
        pairs = pairs.join(who, f"digest_{k}")
    return pairs.select("held_first", "train_first", "held_records", "train_records")


def prompt_members(candidates: DataFrame) -> DataFrame:
    """``(side, first, candidate_id)``, side held or train: which records have the prompt that :func:`linked_prompts` names by ``first``."""
    rows = _candidate_sides(candidates).select("digest", "side", "id").distinct()
    first = rows.groupBy("digest", "side").agg(F.min("id").alias("first"))
    return rows.join(first, ["digest", "side"]).select(F.when(F.col("side") == 0, "held").otherwise("train").alias("side"), "first", F.col("id").alias("candidate_id"))


def similar_prompts(candidates: DataFrame, threshold: float = 0.9, width: int = 5) -> DataFrame:
    """``(held_first, train_first, product)``: prompts of both sides whose vectors, weighted by how rare each term is, have a cosine of at least ``threshold``."""
    rows = _candidate_sides(candidates)
    prompts = written(rows.groupBy("digest", "side", "text").agg(F.min("id").alias("first")))
    found = cosine_join(prompts.select("digest", "side", "text"), threshold, width, "idf")
    for k, name in ((0, "held"), (1, "train")):
        found = found.join(prompts.filter(F.col("side") == k).select(F.col("digest").alias(f"digest_{k}"), F.col("first").alias(f"{name}_first")), f"digest_{k}")
    return found.select("held_first", "train_first", "product")


def overlaps(train: DataFrame, held_out: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(record_kind, key_a, key_b)`` of both kinds."""
    chunks_ = chunk_overlaps(train, held_out).select(F.lit("chunks").alias("record_kind"), "key_a", "key_b")
    records = candidate_overlaps(candidates).select(F.lit("candidates").alias("record_kind"), "key_a", "key_b")
    return chunks_.unionByName(records).distinct()


def overlap_counts(train: DataFrame, held_out: DataFrame, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """``(record_kind, split, source, pairs, held_records)``: overlaps per split and source of the held-out record.

    The source of a chunk is that of the pretraining record it was first seen in; null where there is none.
    """
    place = records.select(F.concat_ws(":", "shard", F.col("line_number").cast("string")).alias("held_key"), F.lower(F.regexp_replace(F.trim("source"), "-", "_")).alias("source"), split_name("split").alias("split"))
    first = place.groupBy("held_key").agg(F.min("source").alias("source"), F.min("split").alias("split"))
    a = chunk_overlaps(train, held_out).join(first, "held_key", "left").select(F.lit("chunks").alias("record_kind"), F.coalesce("split", F.lit("validation")).alias("split"), "source", "key_a", "key_b", "held_key")
    b = candidate_overlaps(candidates).select(F.lit("candidates").alias("record_kind"), F.col("held_split").alias("split"), F.col("held_source").alias("source"), "key_a", "key_b", "held_key")
    return a.unionByName(b).groupBy("record_kind", "split", "source").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("held_key").alias("held_records"))
