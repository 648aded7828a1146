"""Cutting long texts at natural boundaries: structure-tree packing.

A text is parsed into a tree of spans: sections by heading level, then blocks
(paragraphs, list items with their nested items, fenced code, tables), then
markup elements by rank (sections, containers, paragraphs, rows and items), then
lines, sentences, clauses, words and at last single characters. Sibling subtrees are
merged as long as they fit; only a node that is too large is opened. The spans
of the tree cover the text without gaps, so the pieces without their overlap
are exactly the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_columns

_FENCE = re.compile(r"\s{0,3}(```|~~~)")
_HEADING = re.compile(r"\s{0,3}(#{1,6})\s|\s{0,3}<h([1-6])[\s>]", re.I)
_ITEM = re.compile(r"(\s*)(?:[-*+•·]|\(?\d{1,4}[.)、]|[一二三四五六七八九十]{1,3}、)\s*\S")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？；…]+[”’」』）】]*\s*|\n+")
_CLAUSE = re.compile(r"[,;:]\s+|[，、；：]\s*|\s[-–—]\s")
_SPACE = re.compile(r"\s+")
#: Opening tags, outermost elements first; a text is cut before them.
_MARKUP = tuple(
    re.compile(rf"(?=<(?:{names})(?:\s[^<>]*)?>)", re.I)
    for names in ("html|head|body|main|section|article|header|footer|nav|aside", "h1|h2", "h3|h4|h5|h6", "div|table|ul|ol|dl|blockquote|figure|form", "p|pre|thead|tbody|caption|hr", "tr|li|dt|dd|br")
)
_TAGS = re.compile(r"\s*(?:<[^<>]+>\s*)+")
#: What a piece starts at; the number of each is that of the level it is cut at.
BOUNDARIES = ("section", "block", "item", *["element"] * len(_MARKUP), "line", "sentence", "clause", "word", "character")
_LINES = 3 + len(_MARKUP)
_CHARACTERS = _LINES + 4


def _lines(text: str, a: int, b: int) -> list[tuple[int, int]]:
    out, at = [], a
    while at < b:
        end = text.find("\n", at, b)
        end = b if end < 0 else end + 1
        out.append((at, end))
        at = end
    return out


def _blocks(text: str, lines: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Lines of one block each: a fence to its end, an item with what is indented under it, or a paragraph; blank lines end a block."""
    out: list[list[tuple[int, int]]] = []
    fence, indent, blank = "", -1, True
    for a, b in lines:
        line = text[a:b]
        if fence:
            out[-1].append((a, b))
            if line.strip().startswith(fence):
                fence, blank = "", True
            continue
        if not line.strip():
            (out[-1] if out else out.append([]) or out[-1]).append((a, b))
            blank = True
            continue
        opening, item = _FENCE.match(line), _ITEM.match(line)
        depth = len(line) - len(line.lstrip())
        if opening:
            fence = opening[1]
            out.append([(a, b)])
            indent = -1
        elif item and not (indent >= 0 and len(item[1]) > indent):
            out.append([(a, b)])
            indent = len(item[1])
        elif indent >= 0 and (depth > indent or not blank):
            out[-1].append((a, b))
        elif blank or not out:
            out.append([(a, b)])
            indent = -1
        else:
            out[-1].append((a, b))
        blank = False
    return out


def _sections(text: str, lines: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Split before the headings of the highest level there is; empty if there is no heading to split at."""
    levels, fence = [], ""
    for a, b in lines:
        line = text[a:b]
        mark = _FENCE.match(line)
        if fence or mark:
            if mark and (not fence or line.strip().startswith(fence)):
                fence = "" if fence else mark[1]
            levels.append(9)
            continue
        heading = _HEADING.match(line)
        levels.append((len(heading[1]) if heading[1] else int(heading[2])) if heading else 9)
    top = min(levels[1:], default=9)
    if top == 9:
        return []
    out: list[list[tuple[int, int]]] = [[]]
    for k, (span, level) in enumerate(zip(lines, levels)):
        if k and level <= top:
            out.append([])
        out[-1].append(span)
    return out if len(out) > 1 else []


def _cut(text: str, a: int, b: int, at: re.Pattern) -> list[tuple[int, int]]:
    ends = [m.end() for m in at.finditer(text, a, b) if a < m.end() < b]
    return list(zip([a, *ends], [*ends, b]))


def _children(text: str, a: int, b: int, kind: int) -> tuple[list[tuple[int, int, int]], int]:
    """Parts ``(start, end, kind)`` of a node and the level they are cut at; levels are those of BOUNDARIES."""
    lines = _lines(text, a, b) if kind <= _LINES else []
    while kind < _CHARACTERS:
        below = kind + 1
        if kind == 0:
            parts, below = [(s[0][0], s[-1][1]) for s in _sections(text, lines)], 0
        elif kind == 1:
            parts = [(s[0][0], s[-1][1]) for s in _blocks(text, lines)]
        elif kind == 2:
            parts, below = [(s[0][0], s[-1][1]) for s in [lines[:1], *_blocks(text, lines[1:])] if s] if _ITEM.match(text[a:b]) else [], 2
        elif kind < _LINES:
            parts, below = _cut(text, a, b, _MARKUP[kind - 3]), kind
            if len(parts) > 1 and _TAGS.fullmatch(text, *parts[0]):  # opening tags stay with what they open
                parts[:2] = [(parts[0][0], parts[1][1])]
        elif kind == _LINES:
            parts = lines
        else:
            parts = _cut(text, a, b, (_SENTENCE, _CLAUSE, _SPACE)[kind - _LINES - 1])
        if len(parts) > 1:
            return [(x, y, below) for x, y in parts], kind
        kind += 1
    return [], _CHARACTERS


def _character_cut(text: str, a: int, b: int) -> int:
    """The last position in (a, b] that doesn't part a character from its marks."""
    at = b
    while at > a + 1 and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍" or text[at - 1 : at + 1] == "\r\n"):
        at -= 1
    return at if at > a + 1 or b == a + 1 else b


def cuts(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """Consecutive spans ``(start, end, level)`` that cover ``text``; the first has at most ``limit`` characters, the others ``limit - overlap``.

    The level is that of the boundary the span starts at, an index of BOUNDARIES; 0 for the first.
    """

    def room(start: int) -> int:
        return limit - overlap if start else limit

    if len(text) <= limit:
        return [(0, len(text), 0)] if text else []

    def pack(a: int, b: int, kind: int, level: int) -> Iterator[tuple[int, int, int]]:
        parts, at = _children(text, a, b, kind)
        if not parts:
            while b - a > room(a):
                end = _character_cut(text, a, a + room(a))
                yield a, end, level
                a, level = end, _CHARACTERS
            yield a, b, level
            return
        start, end, own = a, a, level
        for x, y, below in parts:
            if y - start <= room(start):
                end = y
                continue
            if end > start:
                yield start, end, own
            start, end, own = x, y, at if x > a else level
            if y - x > room(x):
                *done, (start, end, own) = pack(x, y, below, own)
                yield from done
        if end > start:
            yield start, end, own

    out: list[tuple[int, int, int]] = []
    for a, b, level in pack(0, len(text), 0, 0):
        if out and b - out[-1][0] <= room(out[-1][0]):
            out[-1] = (out[-1][0], b, out[-1][2])
        else:
            out.append((a, b, level))
    return out


def spans(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int]]:
    """The spans of :func:`cuts` alone."""
    return [(a, b) for a, b, _ in cuts(text, limit, overlap)]


def pieces(text: str, limit: int, overlap: int = 0) -> list[str]:
    """The pieces of ``text``: each but the first begins with the last ``overlap`` characters of what stands before it."""
    return [text[max(0, a - overlap) : b] for a, b in spans(text, limit, overlap)]


def split_long(records: DataFrame, key: str = "candidate_id", text: str = "text", limit: int = 3000, overlap: int = 200) -> DataFrame:
    """``(piece_of, piece_index, text, start, n_chars, n_pieces, boundary)`` for every text of more than ``limit`` characters.

    Every piece has at most ``limit`` characters (code points); piece k > 0
    starts with exactly the last ``overlap`` characters before its own part (all of
    them where there are fewer), so
    dropping them and joining the pieces gives the text back. ``boundary`` names
    what the piece's own part starts at (one of BOUNDARIES, ``start`` for the
    first). Only long rows leave
    the scan; nothing is shuffled but the repeated rows, by key. Records cut
    earlier are cut again like any other and name themselves in ``piece_of``.
    Null and empty texts, and texts within the limit, give no piece; a text
    without any boundary is cut between characters. A key that comes with
    several different texts gives the pieces of each.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")

    def run(keys: list, texts: list) -> dict:
        out: dict = {k: [] for k in ("piece_of", "piece_index", "text", "start", "n_chars", "n_pieces", "boundary")}
        for k, t in zip(keys, texts):
            found = cuts(t, limit, overlap)
            for i, (a, b, level) in enumerate(found):
                begin = max(0, a - overlap)
                for name, value in zip(out, (k, i, t[begin:b], begin, b - begin, len(found), BOUNDARIES[level] if i else "start")):
                    out[name].append(value)
        return out

    long = records.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).filter(F.length("t") > limit)
    once = long.withColumn("h", F.xxhash64("t")).dropDuplicates(["k", "h"]).select("k", "t")
    return map_columns(once, run, "piece_of string, piece_index long, text string, start long, n_chars long, n_pieces long, boundary string")


def joined(pieces_: DataFrame) -> DataFrame:
    """``(piece_of, text, longest)``: the pieces of each text joined again without their overlaps, and the longest piece's characters.

    Keys must stand for one text each. Gathers no more than one text a row.
    """
    part = F.struct("piece_index", "start", "n_chars", "text")
    rows = pieces_.groupBy("piece_of").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("n_chars").alias("longest"))
    empty = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("end"))
    whole = F.aggregate("parts", empty, lambda acc, x: F.struct(F.concat(acc["text"], F.substr(x["text"], (acc["end"] - x["start"] + 1).cast("int"))).alias("text"), (x["start"] + x["n_chars"]).alias("end")))
    return rows.select("piece_of", whole["text"].alias("text"), "longest")
