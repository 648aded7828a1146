"""Long exact spans shared between records: relative Lempel-Ziv parsing.

Each distinct text is a reference block, indexed by all its K-character runs.
A document is factored greedily against a block: at every place the longest
match wins. A factor, extended at its boundary, of at least the wanted length
is a shared span. Which documents have to be factored against which blocks is
settled first and without loss by winnowed anchors: two texts with ``length``
consecutive characters in common select the same anchor inside them.

Where all pairs are wanted, all texts with a common anchor meet. Where only the
shared part of each document is, every window of ``length`` characters around a
common anchor is looked up, and a text is factored only against the first text
that has a window of its own: the blocks are as many as there are passages, and
a passage that n texts have costs n factorings, not n squared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import map_columns
from ..functions.unicode import chunks, joined_windows, points, prefix_sums, window_hashes
from ..runtime import written

#: Width of the runs that are indexed; half the wanted length, if that is less.
K = 64
#: The bitmap of anchors has at most this many bits (as a power of 2).
MOST_BITS = 27


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width and len(x) > span:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if 0 < rest < len(x) else x if not rest else x[:0]


def anchor_hashes(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each text's anchors: the runs that are least in some window of ``length`` characters (winnowing).

    The runs have five eighths of the wanted length, so that shorter stretches that
    many texts have (mastheads, menus, licences) bring nobody together.
    """
    run = max(1, length * 5 // 8)
    width = length - run + 1
    hashes, owner, _ = joined_windows(texts, run)
    if len(hashes) < width:
        return hashes[:0], owner[:0]
    least = _sliding_min(hashes, width)
    least = np.where(owner[: len(least)] == owner[width - 1 :], least, np.uint64(0))  # windows lie within one text
    edge = np.zeros(width - 1, dtype=np.uint64)
    chosen = ~_sliding_min(~np.concatenate([edge, least, edge]), width) == hashes
    # a place counts if a window around it has it for its least; the largest of the minima around it can't exceed it
    hashes, owner = hashes[chosen], owner[chosen]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first], owner[first]


class Block:
    """A reference block: its code points and the places of each of its K-character runs."""

    def __init__(self, text: str, run: int = K):
        self.points, self.run = points(text), run
        hashes = window_hashes(prefix_sums(self.points), run)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def places(self, value: np.uint64) -> np.ndarray:
        a, b = np.searchsorted(self.hashes, value, "left"), np.searchsorted(self.hashes, value, "right")
        return self.order[a:b]


def _equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n, at, step = min(len(a), len(b)), 0, 128
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differ.any():
            return at + int(np.argmax(differ))
        at += step
        step *= 4
    return n


def _thinned(places: np.ndarray, hashes: np.ndarray, at: int, run: int) -> np.ndarray:
    """The places without those in the middle of a periodic stretch whose alignments other places make up for.

    A stretch is a longest row of places at one distance of at most ``run``, so that the
    block is periodic from its first place to its last and breaks off less than a
    period beyond. The document's stretch is that of the same distance around
    ``at``. Only where both stretches begin, or both end, at once can a match go
    past them; everywhere else it is the overlap of the two stretches. So these
    places are kept: the first two and the last two, the one at which the first
    places meet, the one at which the last places meet, and the neighbours of
    these two, as a stretch may go on for part of a period. All that the other
    alignments cover of the document, and no less long, they cover too.
    """
    if len(places) <= 64:
        return places
    gaps = np.diff(places)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(gaps)) + 1, [len(gaps)]])
    kept = np.ones(len(places), dtype=bool)
    for s in np.flatnonzero(np.diff(edges) >= 10).tolist():
        first, last = int(edges[s]), int(edges[s + 1])
        gap = int(gaps[first])
        if gap > run:
            continue
        back, on = (_steady(hashes[at::step], hashes[at]) - 1 for step in (-gap, gap))
        want = np.array([first + 1, last - 1, *(first + back + n for n in (-1, 0, 1)), *(last - on + n for n in (-1, 0, 1))])
        kept[first + 1 : last] = False
        kept[want[(want > first) & (want < last)]] = True
    return places[kept]


def _steady(values: np.ndarray, value: np.uint64) -> int:
    """How many of the first values are equal to ``value``."""
    differ = values != value
    return int(np.argmax(differ)) if differ.any() else len(values)


def factors(block: Block, text: str, length: int) -> list[tuple[int, int, int]]:
    """``(start in the block, start in the text, characters)`` of the maximal shared spans met by parsing the text against the block.

    Every run of at least ``length``, twice the width of the block's index, characters of the text that stands in
    the block is inside one of the spans: it lies in one factor, or a factor
    boundary parts it, and at each boundary all places of the runs on either
    side are extended both ways. Of the block's characters only those count that
    a factor was met at; to know all of them, the block is parsed in its turn.
    """
    mine, theirs, run = points(text), block.points, block.run
    hashes = window_hashes(prefix_sums(mine), run)
    if not len(hashes) or not len(block.hashes):
        return []
    at_in = np.minimum(np.searchsorted(block.hashes, hashes), len(block.hashes) - 1)
    known = block.hashes[at_in] == hashes
    starts = np.flatnonzero(known)
    found: dict[tuple[int, int], int] = {}

    def extend(i: int) -> int:
        """Look at every place of the run at i; the end of the longest match to the right."""
        end = i
        if i < 0 or i >= len(hashes) or not known[i]:
            return end
        for j in _thinned(block.places(hashes[i]), hashes, i, run).tolist():
            right = _equal_run(theirs[j:], mine[i:])
            if right < run:
                continue  # equal hashes of different runs
            left = _equal_run(theirs[:j][::-1], mine[:i][::-1])
            end = max(end, i + right)
            if left + right >= length:
                found[j - left, i - left] = left + right
        return end

    k = 0
    while k < len(starts):
        i = int(starts[k])
        end = extend(i)
        extend(end - run)
        k = int(np.searchsorted(starts, max(end, i + 1)))
    return [(j, i, n) for (j, i), n in found.items()]


def _texts(documents: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    return rows.withColumn("digest", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    """``(anchor, digest)`` of every row's text, each once a row."""

    def choose(digests: list, texts: list) -> dict:
        hashes, keys = [np.empty(0, dtype=np.int64)], []
        for a, b in chunks(texts):
            found, owner = anchor_hashes(texts[a:b], length)
            hashes.append(found.view(np.int64))
            keys += [digests[a + k] for k in owner.tolist()]
        return {"anchor": np.concatenate(hashes), "digest": keys}

    return map_columns(rows.select("digest", "text"), choose, "anchor long, digest binary")


def _all_pairs(anchors: DataFrame) -> DataFrame:
    """Every two texts with a common anchor; copies of a text are one before they meet."""
    anchors = written(anchors.distinct())
    a, b = anchors.select("anchor", F.col("digest").alias("digest_a")), anchors.select("anchor", F.col("digest").alias("digest_b"))
    return a.join(b, "anchor").filter("digest_a < digest_b").select("digest_a", "digest_b").distinct()


def anchored_windows(text: str, anchors: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of ``length`` characters that hold one of the anchors, each once."""
    if not len(anchors):
        return np.empty(0, dtype=np.uint64)
    prefix = prefix_sums(points(text))
    run = max(1, length * 5 // 8)
    at = np.flatnonzero(np.isin(window_hashes(prefix, run), anchors))
    marks = np.zeros(len(text) + 2, dtype=np.int64)
    np.add.at(marks, np.maximum(0, at - (length - run)), 1)
    np.add.at(marks, at + 1, -1)
    whole = window_hashes(prefix, length)
    return np.unique(whole[np.cumsum(marks)[: len(whole)] > 0])


def _bitmap(hashes: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """A bitmap of the last bits of 64-bit hashes (anchors are small numbers: their first bits are alike): at most 16 MB, whatever their number."""
    bits = min(MOST_BITS, max(10, (hashes.count() * 256).bit_length()))
    slots = hashes.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("slot"))
    words = slots.select(F.expr("slot div 32").alias("word"), F.expr("shiftleft(1L, cast(slot % 32 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[words["word"].to_numpy()] = words["bit"].to_numpy().astype(np.uint32)
    return bits, out


def _first_pairs(rows: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """For each text and each of its windows that another text has, the first text with that window (for the first, the last).

    Which anchors several texts have goes to every task as a bitmap of fixed
    size, so the texts are read where they lie; what it marks by chance is a
    window that no other text has. Windows are counted with map-side combine and
    joined to one row each, so a window of any number of texts is never gathered.
    """
    shared = anchors.groupBy("anchor").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select("anchor")
    marks = rows.sparkSession.sparkContext.broadcast(_bitmap(shared, "anchor"))

    def windows(digests: list, texts: list) -> dict:
        bits, words = marks.value

        found: list[np.ndarray] = []
        for a, b in chunks(texts):
            hashes, owner = anchor_hashes(texts[a:b], length)
            slot = hashes & np.uint64((1 << bits) - 1)
            hit = (words[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
            hashes, edges = hashes[hit], np.searchsorted(owner[hit], np.arange(b - a + 1))
            found += [anchored_windows(t, hashes[edges[k] : edges[k + 1]], length) for k, t in enumerate(texts[a:b])]
        return {"w": np.concatenate([np.empty(0, dtype=np.uint64), *found]).view(np.int64), "digest": [d for d, f in zip(digests, found) for _ in range(len(f))]}

    held = written(map_columns(rows.select("digest", "text"), windows, "w long, digest binary"))
    ends = held.groupBy("w").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).filter("first <> last")
    links = held.join(ends, "w").select("digest", F.when(F.col("digest") != F.col("first"), F.col("first")).otherwise(F.col("last")).alias("other")).distinct()
    return links.select(F.least("digest", "other").alias("digest_a"), F.greatest("digest", "other").alias("digest_b")).distinct()


def text_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, both_ways: bool = True, all_pairs: bool = True) -> DataFrame:
    """``(digest_a, digest_b, start_a, start_b, n_chars)``: the shared spans of every two different texts, digest_a < digest_b.

    Both texts are parsed, each against the other, so that every shared character
    of either is in a span; with ``both_ways`` off only the second is, which is
    enough to know that there is a span. With ``all_pairs`` off each text is
    factored only against the first texts that have what it shares: every shared
    character of every text is still in a span, of which it has few.

    Texts are known by a 128-bit digest; equal texts are one. Candidates meet by
    anchor (24 bytes for about every 38th character are shuffled, and skewed
    anchors are split by adaptive execution); texts move only where a candidate
    partner exists. Texts shorter than ``length`` and null texts share nothing.
    """
    if length < 2:
        raise ValueError("spans of at least 2 characters")
    run = min(K, length // 2)
    rows = _texts(documents, doc_id, text, length)
    anchors = _anchors(rows, length)
    near = written(_all_pairs(anchors) if all_pairs else _first_pairs(rows, anchors, length))
    wanted = near.select(F.explode(F.array("digest_a", "digest_b")).alias("digest")).distinct()
    texts = written(rows.select("digest", "text").join(wanted, "digest", "left_semi").dropDuplicates(["digest"]))
    both = near.join(texts.select(F.col("digest").alias("digest_b"), F.col("text").alias("text_b")), "digest_b")
    both = both.join(texts.select(F.col("digest").alias("digest_a"), F.col("text").alias("text_a")), "digest_a").sortWithinPartitions("digest_a")

    def parse(digests_a: list, texts_a: list, digests_b: list, texts_b: list) -> dict:
        out: dict = {name: [] for name in ("digest_a", "digest_b", "start_a", "start_b", "n_chars")}
        last, block = None, None
        for da, ta, db, tb in zip(digests_a, texts_a, digests_b, texts_b):
            if da != last:
                last, block = da, Block(ta, run)
            found = set(factors(block, tb, length))
            if found and both_ways:
                found |= {(i, j, n) for j, i, n in factors(Block(tb, run), ta, length)}
            for j, i, n in sorted(found):
                for name, value in zip(out, (da, db, j, i, n)):
                    out[name].append(value)
        return out

    return map_columns(both.select("digest_a", "text_a", "digest_b", "text_b"), parse, "digest_a binary, digest_b binary, start_a long, start_b long, n_chars long")


def members(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """``(digest, doc_id, n_chars)``: which documents have which text."""
    return _texts(documents, doc_id, text, length).select("digest", "doc_id", F.length("text").cast("long").alias("n_chars")).distinct()


def shared_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """``(doc_id_a, doc_id_b)``, a < b: documents with at least ``length`` consecutive characters in common, equal texts included."""
    of = members(documents, doc_id, text, length).select("digest", "doc_id")
    pairs = text_spans(documents, doc_id, text, length, both_ways=False).select("digest_a", "digest_b").distinct()
    a, b = of.select(F.col("digest").alias("digest_a"), F.col("doc_id").alias("a")), of.select(F.col("digest").alias("digest_b"), F.col("doc_id").alias("b"))
    across = pairs.join(a, "digest_a").join(b, "digest_b").select("a", "b")
    same = a.join(b, a.digest_a == b.digest_b).filter("a < b").select("a", "b")
    both = across.unionByName(same).filter("a <> b")
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """``(doc_id_a, doc_id_b, start_a, start_b, n_chars)``: spans between the smallest documents of each two different texts."""
    first = members(documents, doc_id, text, length).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    found = text_spans(documents, doc_id, text, length)
    for side in "ab":
        found = found.join(first.select(F.col("digest").alias(f"digest_{side}"), F.col("doc_id").alias(f"doc_id_{side}")), f"digest_{side}")
    return found.select("doc_id_a", "doc_id_b", "start_a", "start_b", "n_chars")


def shared_share(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """``(doc_id, n_chars, shared_chars, shared_share)`` for every document with a text: how much of it stands elsewhere too.

    Linear in the texts that have a passage; see :func:`text_spans` without all pairs.

    Overlapping spans count once; a text that several documents have is shared as
    a whole. Documents without a shared span have 0; null and empty texts are left out.
    """
    found = text_spans(documents, doc_id, text, length, all_pairs=False)
    parts = found.select("digest_a", "start_a", "n_chars").unionByName(found.select(F.col("digest_b").alias("digest_a"), F.col("start_b").alias("start_a"), "n_chars"))
    parts = parts.select(F.col("digest_a").alias("digest"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("n_chars")).alias("e"))
    parts = parts.groupBy("digest", "s").agg(F.max("e").alias("e"))
    before = W.partitionBy("digest").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    covered = parts.withColumn("past", F.coalesce(F.max("e").over(before), F.lit(0))).groupBy("digest").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "past"))).alias("covered"))
    of = members(documents, doc_id, text, 1)
    copies = of.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    all_ = of.join(copies, "digest").join(covered, "digest", "left")
    chars = F.when((F.col("copies") > 1) & (F.col("n_chars") >= length), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return all_.select("doc_id", "n_chars", chars.cast("long").alias("shared_chars"), (chars / F.col("n_chars")).alias("shared_share"))
