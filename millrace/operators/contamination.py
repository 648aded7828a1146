"""Overlap with benchmark text: equal, contained and near texts, without nested loops."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_columns
from ..functions.unicode import chunks, distinct_grams, joined_windows
from ..runtime import written
from .setjoin import COUNTERS, gathered, jaccard_join, keyed, sketched, slots, verified

#: Most characters of patterns in one broadcast automaton; more patterns are searched in several.
AUTOMATON_CHARS = 4_000_000
_AUTOMATA: dict[str, object] = {}
_ITEMS: dict[str, object] = {}


def equal_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on an equal key; nulls match nothing. Which side is broadcast is the planner's choice by size."""
    return left.filter(F.col(key).isNotNull()).join(right, key)


def contained(texts: DataFrame, text_id: str, text: str, patterns: DataFrame, pattern_id: str, pattern: str, least: int = 20) -> DataFrame:
    """``(text_id, pattern_id)``: texts that contain a pattern of at least ``least`` characters and aren't equal to it.

    The patterns are a stated query set: they are broadcast as Aho-Corasick
    automata of bounded size, in blocks, and every text is read once a block.
    """
    import ahocorasick

    rows = patterns.select(F.col(pattern_id).cast("long").alias("i"), F.col(pattern).alias("p")).filter(F.length("p") >= least).distinct()
    blocks: list[list[tuple[str, list[int]]]] = [[]]
    size, by = 0, {}
    for r in rows.toLocalIterator():
        by.setdefault(r.p, []).append(r.i)
    for p, ids in sorted(by.items()):
        if size + len(p) > AUTOMATON_CHARS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((p, ids))
        size += len(p)
    spark, out = texts.sparkSession, None
    docs = texts.select(F.col(text_id).cast("long"), F.col(text)).filter(F.length(text) >= least)
    for block in blocks:
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def search(ids: list, values: list, shared=shared) -> dict:
            name, patterns_ = shared.value
            if name not in _AUTOMATA:
                _AUTOMATA.clear()
                automaton = ahocorasick.Automaton()
                for p, owners in patterns_:
                    automaton.add_word(p, (p, owners))
                if patterns_:
                    automaton.make_automaton()
                _AUTOMATA[name] = automaton
            res: dict = {"text_id": [], "pattern_id": []}
            for i, t in zip(ids, values):
                hits = {p: owners for _, (p, owners) in _AUTOMATA[name].iter(t) if p != t} if patterns_ else {}
                for owners in hits.values():
                    res["text_id"] += [i] * len(owners)
                    res["pattern_id"] += owners
            return res

        part = map_columns(docs, search, "text_id long, pattern_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def containment_pairs(texts: DataFrame, patterns: DataFrame, least: int = 20) -> DataFrame:
    """``(id_a, id_b)``: texts (a) that contain a pattern (b) of at least ``least`` >= 12 characters and aren't equal to it; both ``(id, text)`` with unique ids.

    As :func:`contained`, for patterns that grow with the data: nothing of them is
    broadcast. Of every window of ``least`` characters the least hash of its runs
    of 8 characters is posted by the text; a pattern needs only one of its own,
    and takes the one that the fewest texts post (by hashed counters, of fixed number).
    """
    run = 8

    def minima(values: list[str]):
        hashes, owner, _ = joined_windows(values, run)
        width = least - run + 1
        if len(hashes) < width:
            return hashes[:0], owner[:0]
        low = np.lib.stride_tricks.sliding_window_view(hashes, width).min(axis=1)
        inside = owner[: len(low)] == owner[width - 1 :]  # windows lie within one text
        low, owner = low[inside], owner[: len(inside)][inside]
        order = np.lexsort((low, owner))
        low, owner = low[order], owner[order]
        new = np.ones(len(low), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
        return low[new], owner[new]

    def count(values: list) -> dict:
        n = np.zeros(COUNTERS, dtype=np.int64)
        for first, last in chunks(values):
            n += np.bincount(slots(minima(values[first:last])[0]), minlength=COUNTERS)
        seen = np.flatnonzero(n)
        return {"slot": seen, "n": n[seen]}

    left, right = keyed(texts.filter(F.length("text") > least)), keyed(patterns.filter(F.length("text") >= least))
    known = texts.sparkSession.sparkContext.broadcast(gathered(map_columns(left.select("text"), count, "slot long, n long")))

    def post(one: bool):
        def run_(keys: list, values: list) -> dict:
            out: dict = {"anchor": [np.empty(0, dtype=np.int64)], "key": [np.empty(0, dtype=np.int64)]}
            every = np.array(keys, dtype=np.int64)
            for first, last in chunks(values):
                low, owner = minima(values[first:last])
                if one and len(low):
                    order = np.lexsort((low, known.value[slots(low)], owner))
                    low, owner = low[order], owner[order]
                    owner, starts = _segments(low, owner)
                    low = low[starts]
                out["anchor"].append(low.view(np.int64))
                out["key"].append(every[first:last][owner])
            return {k: np.concatenate(v) for k, v in out.items()}

        return run_

    a = map_columns(left.select("key", "text"), post(False), "anchor long, key long")
    b = map_columns(right.select("key", "text"), post(True), "anchor long, key long")
    near = a.select("anchor", F.col("key").alias("a")).join(b.select("anchor", F.col("key").alias("b")), "anchor").select("a", "b").distinct()
    both = near.join(right.select(F.col("key").alias("b"), F.col("id").alias("id_b"), F.col("text").alias("pattern")), "b").join(left.select(F.col("key").alias("a"), F.col("id").alias("id_a"), "text"), "a")
    return both.filter(F.contains("text", "pattern") & (F.col("text") != F.col("pattern"))).select("id_a", "id_b")


class _Items:
    """A block of test items with what finds those near a text: their least grams, and their SimHash bytes."""

    def __init__(self, block: list[tuple[str, list[int]]], width: int, threshold: float):
        self.width, self.threshold = width, threshold
        self.texts, self.owners = [p for p, _ in block], [ids for _, ids in block]
        self.sets = [{t[k : k + width] for k in range(len(t) - width + 1)} for t in self.texts]
        hashes, owner = distinct_grams(self.texts, width)
        self.who, starts = _segments(hashes, owner)
        self.bits = _simhash(hashes, starts)
        sizes = np.diff(np.append(starts, len(hashes)))
        self.sizes = sizes
        self.grams = self._sorted(hashes, np.repeat(np.arange(len(self.who)), sizes))
        self.known, self.often = np.unique(hashes, return_counts=True)
        self.bytes = [self._sorted(self._byte(self.bits, b), np.arange(len(self.who))) for b in range(8)]

    @staticmethod
    def _byte(bits: np.ndarray, band: int) -> np.ndarray:
        return (bits >> np.uint64(8 * band)) & np.uint64(0xFF)

    @staticmethod
    def _sorted(keys: np.ndarray, segment: np.ndarray):
        order = np.argsort(keys, kind="stable")
        return keys[order], segment[order]

    def _least(self, hashes: np.ndarray, starts: np.ndarray):
        """Of each segment's grams that items have, so many of the rarest that an item at the threshold has one of them; and the segment.

        A near item has at least a share ``threshold`` of the segment's grams, so
        a segment of which fewer are in any item has none.
        """
        n = np.diff(np.append(starts, len(hashes)))
        segment = np.repeat(np.arange(len(n)), n)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        mine = np.flatnonzero(self.known[at] == hashes)
        hashes, segment, often = hashes[mine], segment[mine], self.often[at[mine]]
        count = np.bincount(segment, minlength=len(n))
        order = np.lexsort((hashes, often, segment))
        hashes, segment = hashes[order], segment[order]
        place = np.arange(len(hashes)) - (np.cumsum(count) - count)[segment]
        kept = place <= (count - np.ceil(self.threshold * n - 1e-9).astype(np.int64))[segment]
        return hashes[kept], segment[kept]

    @staticmethod
    def _meet(keys: np.ndarray, rows: np.ndarray, index) -> np.ndarray:
        known, segment = index
        first, last = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
        times = last - first
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
        return np.unique(np.stack([np.repeat(rows, times), segment[entry]]), axis=1)

    def near(self, values: list[str], distance: int | None):
        """``(row, item, jaccard)``: by the least grams, or by an equal byte of the SimHash and at most ``distance`` other bits."""
        hashes, owner = distinct_grams(values, self.width)
        who, starts = _segments(hashes, owner)
        if not len(who) or not len(self.who):
            return
        if distance is None:
            pairs = self._meet(*self._least(hashes, starts), self.grams)
            m, n = np.diff(np.append(starts, len(hashes)))[pairs[0]], self.sizes[pairs[1]]
            pairs = pairs[:, np.minimum(m, n) >= self.threshold * np.maximum(m, n) - 1e-9]
        else:
            bits = _simhash(hashes, starts)
            pairs = np.concatenate([self._meet(self._byte(bits, b), np.arange(len(who)), self.bytes[b]) for b in range(8)], axis=1)
            pairs = np.unique(pairs[:, np.bitwise_count(bits[pairs[0]] ^ self.bits[pairs[1]]) <= distance], axis=1)
        last, mine = -1, set()
        for r, k in zip(who[pairs[0]].tolist(), self.who[pairs[1]].tolist()):
            if r != last:
                last, t = r, values[r]
                mine = {t[i : i + self.width] for i in range(len(t) - self.width + 1)}
            common, union = len(mine & self.sets[k]), len(mine | self.sets[k])
            if common >= self.threshold * union - 1e-12 and (distance is None or common < union):
                yield r, k, common / union


def near_items(
    texts: DataFrame, text_id: str, text: str, items: DataFrame, item_id: str, item: str, width: int = 5, threshold: float = 0.8, distance: int | None = None, form: Callable[[str], str] | None = None
) -> DataFrame:
    """``(text_id, item_id, jaccard)``: texts and test items whose grams have a Jaccard of at least ``threshold``, equal ones included.

    With ``distance`` the near join of the reference's audit: an equal byte of the
    64-bit SimHash, at most ``distance`` different bits and a Jaccard below 1.
    ``form`` is applied to the texts first. The items are a stated query set: they
    are broadcast in blocks, and every text is read once a block.
    """
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item).alias("p")).filter("i is not null and p is not null").distinct()
    by: dict[str, list[int]] = {}
    for r in rows.toLocalIterator():
        by.setdefault(r.p, []).append(r.i)
    blocks: list[list[tuple[str, list[int]]]] = [[]]
    size = 0
    for p, ids in sorted(by.items()):
        if size + len(p) > AUTOMATON_CHARS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((p, ids))
        size += len(p)
    docs = texts.select(F.col(text_id), F.col(text)).filter(F.col(text_id).isNotNull() & F.col(text).isNotNull())
    kind, out = docs.schema[0].dataType.simpleString(), None
    for block in blocks:
        shared = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block))

        def search(ids: list, values: list, shared=shared) -> dict:
            name, block_ = shared.value
            if name not in _ITEMS:
                _ITEMS.clear()
                _ITEMS[name] = _Items(block_, width, threshold)
            known = _ITEMS[name]
            values = [form(t) for t in values] if form else values
            res: dict = {"text_id": [], "item_id": [], "jaccard": []}
            for a, b in chunks(values):
                for r, k, score in known.near(values[a:b], distance):
                    for i in known.owners[k]:
                        for field, value in zip(res, (ids[a + r], i, score)):
                            res[field].append(value)
            return res

        part = map_columns(docs, search, f"text_id {kind}, item_id long, jaccard double")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _distinct_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, text)``: each text once, by its digest, with the smallest key that has it."""
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.groupBy(F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("digest")).agg(F.min("id").alias("id"), F.first("text").alias("text")).select("id", "text")


def _banded(texts: DataFrame, signature, bands: int) -> DataFrame:
    """Pairs a < b of keys that share a band; bands met by one only never pair."""
    def band(ids: list, values: list) -> dict:
        keys, owners = [], []
        for first, last in chunks(values):
            rows, sig = signature(values[first:last])
            keys.append(sig.reshape(-1))
            owners += [ids[first + r] for r in np.repeat(rows, bands).tolist()]
        return {"band": np.concatenate(keys), "id": owners}

    posted = map_columns(texts.select("key", "text"), band, "band long, id long")
    return posted.select("band", F.col("id").alias("a")).join(posted.select("band", F.col("id").alias("b")), "band").filter("a < b").select("a", "b").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "jaccard").distinct()


def _segments(values: np.ndarray, owner: np.ndarray):
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, dtype=np.int64)
    return owner[starts], starts


def _simhash(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits for each segment: set where at least half of its hashes set them."""
    n = np.diff(np.append(starts, len(hashes)))
    bits = np.zeros(len(starts), dtype=np.uint64)
    for k in range(64):
        ones = np.add.reduceat(((hashes >> np.uint64(k)) & np.uint64(1)).astype(np.int64), starts) if len(starts) else n
        bits |= np.where(2 * ones >= n, np.uint64(1) << np.uint64(k), np.uint64(0))
    return bits


def minhash_pairs(df: DataFrame, key: str, text: str, width: int = 5, permutations: int = 128, rows: int = 4, threshold: float = 0.8, seed: int = 42) -> DataFrame:
    """``(id_a, id_b, jaccard)`` of different texts that share a MinHash band and have an exact Jaccard of at least ``threshold``.

    Equal texts are collapsed first; ids are the smallest of each text.
    """
    rng = np.random.default_rng(seed)
    factors, shifts = (rng.integers(1, 1 << 63, permutations, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    bands = permutations // rows

    def signature(values: list[str]):
        hashes, owner = distinct_grams(values, width)
        who, starts = _segments(hashes, owner)
        out = np.empty((len(who), bands), dtype=np.uint64)
        for b in range(bands):
            mix = np.full(len(who), b, dtype=np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                low = np.minimum.reduceat((hashes * factors[k] + shifts[k]) >> np.uint64(1), starts) if len(starts) else np.empty(0, dtype=np.uint64)
                mix = (mix * np.uint64(0x9E3779B97F4A7C15)) ^ low
            out[:, b] = mix
        return who, out.view(np.int64)

    texts = keyed(written(_distinct_texts(df, key, text)))
    return _ordered(verified(sketched(_banded(texts, signature, bands), texts, texts, width, threshold), texts, texts, width, threshold))


def simhash_pairs(df: DataFrame, key: str, text: str, width: int = 5, bands: int = 8, threshold: float = 0.8) -> DataFrame:
    """``(id_a, id_b, jaccard)`` of different texts that share one of the 64-bit SimHash's bands, checked by exact Jaccard.

    The signature of the reference: a bit is set where at least half of the n-grams set it.
    """

    def signature(values: list[str]):
        hashes, owner = distinct_grams(values, width)
        who, starts = _segments(hashes, owner)
        bits = _simhash(hashes, starts)
        step = 64 // bands
        parts = np.stack([((bits >> np.uint64(step * b)) & np.uint64((1 << step) - 1)) | (np.uint64(b) << np.uint64(56)) for b in range(bands)], axis=1) if len(who) else np.empty((0, bands), dtype=np.uint64)
        return who, parts.view(np.int64)

    texts = keyed(written(_distinct_texts(df, key, text)))
    return _ordered(verified(sketched(_banded(texts, signature, bands), texts, texts, width, threshold), texts, texts, width, threshold))


def gram_pairs_across(left: DataFrame, right: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(id_a, id_b, jaccard)`` of all texts of ``left`` and ``right``, both ``(id, text)`` with unique ids, with an exact Jaccard of at least ``threshold``."""
    return jaccard_join(left, right, width, threshold)


def gram_pairs(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(id_a, id_b, jaccard)`` of all different texts with an exact Jaccard of at least ``threshold``; ids are the smallest of each text."""
    return jaccard_join(written(_distinct_texts(df, key, text)), None, width, threshold)
