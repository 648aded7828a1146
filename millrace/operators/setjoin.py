"""Exact Jaccard joins of character n-gram sets: rare-first inverted lists with bounds by size and position.

The n-grams of a text are ordered by how rare they are among all texts (hashed
counters, of fixed number), and only so many of the rarest are listed that two
texts at the threshold must meet in one. Each meeting bounds what the two can
have in common; what is left is compared by parity sketches and at last in full.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_columns
from ..functions.unicode import chunks, distinct_grams
from ..runtime import written

#: Terms share this many counters; 8 bytes each are broadcast, whatever the data.
COUNTERS = 1 << 19
#: Texts that list a term in one part; the lists of more frequent terms are split.
HOT_LIST = 100_000
_SHIFT = np.uint64(64 - 19)
_WORDS = 4


def keyed(texts: DataFrame) -> DataFrame:
    """``(key, id, text)``: 64 bits stand for the id, whatever its size, wherever rows are shuffled."""
    return texts.select(F.xxhash64("id").alias("key"), "id", "text")


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _SHIFT).astype(np.int64)


def gathered(counts: DataFrame) -> np.ndarray:
    """Sum up ``(slot, n)``; at most COUNTERS rows come to the driver, however many texts were counted."""
    found = counts.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """In how many texts the grams of each counter occur; at most COUNTERS rows come to the driver."""

    def count(values: list) -> dict:
        n = np.zeros(COUNTERS, dtype=np.int64)
        for a, b in chunks(values):
            n += np.bincount(slots(distinct_grams(values[a:b], width)[0]), minlength=COUNTERS)
        seen = np.flatnonzero(n)
        return {"slot": seen, "n": n[seen]}

    return gathered(map_columns(texts.select("text"), count, "slot long, n long"))


def _listed(texts: DataFrame, known, width: int, threshold: float) -> DataFrame:
    """``(gram, parts, key, n, place)``: the rarest grams of each text, as many as the threshold needs; parts is in how many the gram's list is split."""

    def post(keys: list, values: list) -> dict:
        out: dict = {name: [np.empty(0, dtype=np.int64)] for name in ("gram", "parts", "n", "place", "key")}
        every = np.array(keys, dtype=np.int64)
        for a, b in chunks(values):
            hashes, owner = distinct_grams(values[a:b], width)
            often = known.value[slots(hashes)]
            order = np.lexsort((hashes, often, owner))
            hashes, owner, often = hashes[order], owner[order], often[order]
            size = np.bincount(owner, minlength=b - a)
            place = np.arange(len(hashes)) - (np.cumsum(size) - size)[owner]
            keep = np.flatnonzero(place <= (size - np.ceil(threshold * size - 1e-9).astype(np.int64))[owner])
            out["gram"].append(hashes[keep].view(np.int64))
            out["parts"].append(often[keep] // HOT_LIST + 1)
            out["n"].append(size[owner[keep]])
            out["place"].append(place[keep])
            out["key"].append(every[a:b][owner[keep]])
        return {k: np.concatenate(v) for k, v in out.items()}

    return map_columns(texts.select("key", "text"), post, "gram long, parts int, key long, n int, place int")


def _sketches(texts: DataFrame, width: int, side: str) -> DataFrame:
    """Parity sketches: each gram flips a bit, so two differ in no more bits than the sets do in grams."""

    def sketch(keys: list, values: list) -> dict:
        flips = np.zeros((len(values), _WORDS * 64), dtype=np.int64)
        size = np.zeros(len(values), dtype=np.int64)
        for a, b in chunks(values):
            hashes, owner = distinct_grams(values[a:b], width)
            size[a:b] = np.bincount(owner, minlength=b - a)
            np.add.at(flips, (owner + a, (hashes % np.uint64(_WORDS * 64)).astype(np.int64)), 1)
        bits = np.packbits((flips & 1).astype(np.uint8), axis=1).view(np.int64)
        return {side: keys, f"{side}n": size} | {f"{side}{i}": bits[:, i] for i in range(_WORDS)}

    return map_columns(texts.select("key", "text"), sketch, f"{side} long, {side}n long, " + ", ".join(f"{side}{i} long" for i in range(_WORDS)))


def sketched(pairs: DataFrame, left: DataFrame, right: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` of keys whose sizes and parity sketches allow a Jaccard of ``threshold``; none that has it is lost."""
    both = pairs.join(_sketches(left, width, "a"), "a").join(_sketches(right, width, "b"), "b")
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(_WORDS)), F.lit(0))
    sizes = F.least("an", "bn") >= threshold * F.greatest("an", "bn") - 1e-9
    return both.filter(sizes & (differ <= (1 - threshold) / (1 + threshold) * (F.col("an") + F.col("bn")) + 1e-6)).select("a", "b")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, width: int, threshold: float) -> DataFrame:
    """``(id_a, id_b, jaccard)`` of the pairs ``(a, b)`` of keys that reach the threshold; grams are compared by 64-bit hashes.

    ``left`` and ``right`` are ``(key, id, text)``.
    """
    both = pairs.join(left.select(F.col("key").alias("a"), F.col("id").alias("ia"), F.col("text").alias("ta")), "a").join(right.select(F.col("key").alias("b"), F.col("id").alias("ib"), F.col("text").alias("tb")), "b")

    def settle(a: list, ta: list, b: list, tb: list) -> dict:
        out: dict = {"id_a": [], "id_b": [], "jaccard": []}
        for first, last in chunks([x + y for x, y in zip(ta, tb)]):
            sets = []
            for texts in (ta[first:last], tb[first:last]):
                hashes, owner = distinct_grams(texts, width)
                sets.append(np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts)))))
            for k, (p, q) in enumerate(zip(*sets)):
                common = len(np.intersect1d(p, q, assume_unique=True))
                union = len(p) + len(q) - common
                if union and common >= threshold * union - 1e-12:
                    for name, value in zip(out, (a[first + k], b[first + k], common / union)):
                        out[name].append(value)
        return out

    kinds = [frame.schema["id"].dataType.simpleString() for frame in (left, right)]
    return map_columns(both.select("ia", "ta", "ib", "tb"), settle, f"id_a {kinds[0]}, id_b {kinds[1]}, jaccard double")


def jaccard_join(left: DataFrame, right: DataFrame | None = None, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(id_a, id_b, jaccard)`` of all texts of ``left`` and ``right``, both ``(id, text)`` with unique ids, that reach the threshold.

    Without ``right`` the pairs ``id_a < id_b`` within ``left``. None is missing.
    Texts shorter than ``width`` have no grams and match nothing; nulls must be left out.
    """
    own = right is None
    left = keyed(left)
    right = left if own else keyed(right)
    texts = left.select("text") if own else left.select("text").unionByName(right.select("text"))
    known = left.sparkSession.sparkContext.broadcast(_frequencies(texts, width))
    a = _listed(left, known, width, threshold).select("gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("key").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"))
    b = _listed(right, known, width, threshold).select("gram", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    met = a.join(b, ["gram", "part"])
    met = met.filter("a < b") if own else met
    need = F.ceil(threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-6).cast("int")
    met = met.select("a", "b", "na", "nb", need.alias("need"), F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")).alias("left")).filter("left >= need")
    near = met.groupBy("a", "b", "na", "nb", "need").agg(F.count(F.lit(1)).alias("common"), F.min("left").alias("left")).filter("common + left - 1 >= need")
    near = sketched(near.select("a", "b"), left, right, width, threshold)
    if not own:
        return verified(written(near), left, right, width, threshold)
    twins = left.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("key").alias("a"), F.col("key").alias("b"))  # ids that share a key: none, if hashes are kind
    found = verified(written(near.unionByName(twins)), left, right, width, threshold).filter("id_a <> id_b")
    return found.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "jaccard").distinct()
