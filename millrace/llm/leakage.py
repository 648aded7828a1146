"""Evaluation texts inside training text: a broadcast hash set of test n-grams.

The n-grams (character runs of the normal form) of the test items are hashed
into a set of bounded size; every document is scanned window by window against
it, and each hit is verified by comparing the two texts along their diagonal.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import map_columns
from ..functions.unicode import chunks, joined_windows, letters_digits, points, prefix_sums, window_hashes

#: Window widths; an item uses the largest one that its shortest leaking run can hold.
WIDTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
#: Most characters of test items in one broadcast set; more items are scanned in blocks of this size.
BLOCK_CHARS = 8_000_000
_BITS = 22
#: Hits of one batch that are looked at together.
_HITS = 1 << 20
_ALNUM = re.compile(r"[^\W_]")


def equal_runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal places of two equally long arrays."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], a == b, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def longest_run(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Start and length of the longest run of equal places of two equally long arrays."""
    starts, ends = equal_runs(a, b)
    if not len(starts):
        return 0, 0
    k = int(np.argmax(ends - starts))
    return int(starts[k]), int(ends[k] - starts[k])


def _merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, as sorted intervals that don't overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class NgramSet:
    """The n-grams of a block of test items, by window width, behind a bitmap.

    A run of ``need`` characters holds ``need - width + 1`` windows in a row, so
    of an item's windows every such many-th is enough: each leaking run has one.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, points(form)) for i, form in items]
        self.need = [(len(p) + 1) // 2 for _, p in self.items]
        by_width: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, p) in enumerate(self.items):
            width = max(w for w in WIDTHS if w <= self.need[k])
            step = self.need[k] - width + 1
            by_width.setdefault(width, []).append((window_hashes(prefix_sums(p), width)[::step], k, step))
        self.widths = {}
        for width, entries in by_width.items():
            hashes = np.concatenate([h for h, _, _ in entries])
            item = np.concatenate([np.full(len(h), k) for h, k, _ in entries])
            at = np.concatenate([np.arange(len(h)) * step for h, _, step in entries])
            order = np.argsort(hashes, kind="stable")
            bitmap = np.zeros(1 << _BITS, dtype=bool)
            bitmap[hashes >> np.uint64(64 - _BITS)] = True
            self.widths[width] = (hashes[order], item[order], at[order], bitmap)

    def _diagonals(self, forms: list[str]):
        """``(row, item index, shift, start in the item, item part, form part)``: every diagonal with a hit, width by width."""
        for width, (hashes, item, at, bitmap) in self.widths.items():
            found, owner, place = joined_windows(forms, width)
            near = np.flatnonzero(bitmap[found >> np.uint64(64 - _BITS)])
            found, owner, place = found[near], owner[near], place[near]
            first, last = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
            hit = np.flatnonzero(last > first)
            if not len(hit):
                continue
            ends = np.cumsum((last - first)[hit])
            lines = np.empty((3, 0), dtype=np.int64)
            for part in np.split(hit, np.flatnonzero(np.diff(ends // _HITS)) + 1):  # a hot n-gram is met many times
                times = (last - first)[part]
                entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[part], times)
                row, where = np.repeat(owner[part], times), np.repeat(place[part], times)
                lines = np.unique(np.concatenate([lines, np.stack([row, item[entry], where - at[entry]])], axis=1), axis=1)
            last_row, form = -1, np.empty(0, dtype=np.uint32)
            for r, k, shift in lines.T.tolist():
                if r != last_row:
                    last_row, form = r, points(forms[r])
                mine = self.items[k][1]
                a, b = max(0, -shift), min(len(mine), len(form) - shift)
                yield r, k, shift, a, mine[a:b], form[a + shift : b + shift]

    def scan(self, forms: list[str]):
        """``(row, item index, start in the item, start in the form, length)`` of the longest leaking run of each row and item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for r, k, shift, a, mine, form in self._diagonals(forms):
            start, length = longest_run(mine, form)
            if length >= self.need[k] and length > best.get((r, k), (0, 0, 0))[2]:
                best[r, k] = (a + start, a + start + shift, length)
        for (r, k), (i, j, length) in best.items():
            yield r, k, i, j, length

    def scan_all(self, forms: list[str]):
        """``(row, item index, start in the form, length)``: all that the leaking runs of each row and item cover, runs that touch as one."""
        parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r, k, shift, a, mine, form in self._diagonals(forms):
            starts, ends = equal_runs(mine, form)
            long = ends - starts >= self.need[k]
            if long.any():
                parts.setdefault((r, k), []).extend(zip((starts[long] + a + shift).tolist(), (ends[long] + a + shift).tolist()))
        for (r, k), runs in parts.items():
            for first, last in _merged(runs):
                yield r, k, first, last - first


def _blocks(items: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    out: list[list[tuple[int, str]]] = [[]]
    size = 0
    for item in items:
        if size + len(item[1]) > BLOCK_CHARS and out[-1]:
            out.append([])
            size = 0
        out[-1].append(item)
        size += len(item[1])
    return out


def _scanned(documents: DataFrame, tests: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, rows_of, schema: str) -> DataFrame:
    """Distinct rows ``(item_id, doc_id, ...)``, the rest as ``rows_of(set, forms)`` gives it after ``(row, item index)``.

    The documents are scanned where they lie, without a shuffle: the test set is
    what is broadcast, in blocks of at most BLOCK_CHARS characters, one scan each.
    """
    rows = tests.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").distinct()
    items = sorted((r.i, letters_digits(r.t, nfkc=True)) for r in rows.toLocalIterator())
    by_form: dict[str, list[int]] = {}
    for i, form in items:
        if form:
            by_form.setdefault(form, []).append(i)
    forms = sorted(by_form.items())
    names = [part.split()[0] for part in schema.split(", ")]
    docs = documents.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).filter("d is not null and t is not null")
    spark = documents.sparkSession
    out = None
    for block in _blocks([(k, form) for k, (form, _) in enumerate(forms)]):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block, {k: forms[k][1] for k, _ in block}))

        def run(ids: list, texts: list, shared=shared) -> dict:
            name_of, block, ids_of = shared.value
            known = _SETS.get(name_of)
            if known is None:
                _SETS.clear()
                known = _SETS[name_of] = NgramSet(block)
            res: dict = {name: [] for name in names}
            normal = [letters_digits(t, nfkc=True) for t in texts]
            for a, b in chunks(normal):
                for r, k, *rest in rows_of(known, normal[a:b]):
                    for item in ids_of[known.items[k][0]]:
                        for name, value in zip(names, (item, ids[a + r], *rest)):
                            res[name].append(value)
            return res

        part = map_columns(docs, run, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def leaks(
    documents: DataFrame, tests: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "normalized_prompt"
) -> DataFrame:
    """``(item_id, doc_id, item_start, doc_start, run_chars, item_chars)``: one row for each item and document it leaked into.

    Normal form: NFKC, case-folded, letters and digits only. An item leaked if an
    unbroken run of at least half of its normal form's characters occurs in the
    document's normal form; the longest such run is given, places count in the
    normal forms. Null texts and items without a letter or digit match nothing.
    Items with equal text under several ids give a row each; a document id that
    comes with several rows is reported once for each distinct row of the result.
    """

    def longest(known: NgramSet, forms: list[str]):
        for r, k, i, j, length in known.scan(forms):
            yield r, k, i, j, length, len(known.items[k][1])

    return _scanned(documents, tests, doc_id, text, item_id, item_text, longest, "item_id long, doc_id long, item_start long, doc_start long, run_chars long, item_chars long")


def leaked_runs(
    documents: DataFrame, tests: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "normalized_prompt"
) -> DataFrame:
    """``(item_id, doc_id, doc_start, run_chars)``: every place that an item leaked to, as :func:`without_leaks` needs it.

    As :func:`leaks`, but with all runs of at least half of the item instead of
    the longest; runs of one item that overlap or touch in the document are one.
    """
    return _scanned(documents, tests, doc_id, text, item_id, item_text, NgramSet.scan_all, "item_id long, doc_id long, doc_start long, run_chars long")


_SETS: dict[str, NgramSet] = {}


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that NFKC may join to what stands before them: marks, and the second parts of composed characters."""
    second: set[str] = set()
    for c in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(chr(int(parts[1], 16)))
    second.update(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))  # vowels and finals of Hangul syllables
    return frozenset(second)


@lru_cache(maxsize=1 << 16)
def _opens(ch: str) -> bool:
    """The normal form can be cut before this character: it begins with one that joins nothing before it."""
    first = unicodedata.normalize("NFKD", ch)[:1]
    return not unicodedata.combining(first) and first not in _joining()


def _segments(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The normal form of ``text`` and, for each of its characters, where the segment it comes from starts and ends.

    Segments are the shortest stretches whose normal forms, joined, are that of
    the whole text: NFKC composes and reorders within them only.
    """
    if text.isascii():
        places = np.array([m.start() for m in _ALNUM.finditer(text)], dtype=np.int64)
        return letters_digits(text), places, places + 1
    cuts = [i for i, ch in enumerate(text) if not i or _opens(ch)] + [len(text)]
    form, sizes = [], []
    for a, b in zip(cuts, cuts[1:]):
        form.append(letters_digits(text[a:b], nfkc=True))
        sizes.append(len(form[-1]))
    edges = np.array(cuts, dtype=np.int64)
    return "".join(form), np.repeat(edges[:-1], sizes), np.repeat(edges[1:], sizes)


def without_leaks(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", mode: str = "span") -> DataFrame:
    """The documents with what leaked taken out: the spans (``mode="span"``) or whole documents (``"document"``).

    ``found`` is :func:`leaked_runs`; :func:`leaks` is enough for whole documents only, as it has one place of each item.
    ``(doc_id, text, removed_chars, leaked_items)`` for every document; with mode
    "document" those with a leak are left out. A span is cut in the original
    text from its first to its last character, each with the marks that belong
    to it; nothing else is removed. Documents without a leak, and
    those with a null text, come back as they are.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if mode == "document":
        kept = docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
        return kept.select("doc_id", "text", F.lit(0).cast("long").alias("removed_chars"), F.lit(0).cast("long").alias("leaked_items"))
    runs = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("doc_start", "run_chars"))).alias("runs"), F.countDistinct("item_id").alias("leaked_items"))

    def run(ids: list, texts: list, spans: list, items: list) -> dict:
        out: dict = {"doc_id": ids, "text": [], "removed_chars": [], "leaked_items": items}
        for t, runs in zip(texts, spans):
            _, starts, ends = _segments(t)
            kept, at = [], 0
            for s in runs:
                a, b = int(starts[s["doc_start"]]), int(ends[s["doc_start"] + s["run_chars"] - 1])
                if b > at:
                    kept.append(t[at : max(at, a)])
                    at = b
            kept.append(t[at:])
            out["text"].append("".join(kept))
            out["removed_chars"].append(len(t) - len(out["text"][-1]))
        return out

    hit = docs.join(runs, "doc_id").select("doc_id", "text", "runs", "leaked_items")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("removed_chars", T.LongType()), T.StructField("leaked_items", T.LongType())])
    rest = docs.join(runs.select("doc_id"), "doc_id", "left_anti").select("doc_id", "text", F.lit(0).cast("long").alias("removed_chars"), F.lit(0).cast("long").alias("leaked_items"))
    return map_columns(hit, run, schema).unionByName(rest)
