"""Vectorised work on code points, for Python stages that need exact Unicode rules."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

_NOT_ALNUM = re.compile(r"[\W_]+")
_SPACE = re.compile(r"\s+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def letters_digits(text: str | None, nfkc: bool = False) -> str:
    """Case-folded letters and digits of ``text``, in order; null gives an empty string."""
    if not text:
        return ""
    if nfkc and not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _NOT_ALNUM.sub("", text.casefold())


def spaced(text: str | None) -> str:
    """NFKC, case-folded, each blank run one space."""
    if not text:
        return ""
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", text).casefold()).strip()


def points(text: str) -> np.ndarray:
    """Code points of ``text`` as unsigned 32-bit numbers (lone surrogates included)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _series(base: int, length: int) -> np.ndarray:
    out = np.full(length, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(length: int) -> np.ndarray:
    return _series(int(_MULTIPLIER), length)


@lru_cache(maxsize=4)
def _inverse_powers(length: int) -> np.ndarray:
    return _series(pow(int(_MULTIPLIER), -1, 1 << 64), length)


def _room(n: int) -> int:
    return max(4096, 1 << (n - 1).bit_length()) if n else 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers so that their high and low bits are usable alike."""
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def prefix_sums(cp: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes; :func:`window_hashes` reads any window length from them."""
    n = len(cp)
    out = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mixed(cp.astype(np.uint64) + np.uint64(1)) * _powers(_room(n))[:n], out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` code points; the same run hashes alike anywhere."""
    n = len(prefix) - 1 - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    return mixed((prefix[width:] - prefix[:n]) * _inverse_powers(_room(len(prefix)))[:n])


def chunks(texts: list[str], most: int = 1 << 20):
    """Runs of rows ``(first, last)`` with about ``most`` characters each, whole texts only."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def joined_windows(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and position of every ``width``-character run of every text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    hashes = window_hashes(prefix_sums(points("".join(texts))), width)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(hashes)]
    at = np.arange(len(hashes)) - starts[owner]
    inside = at + width <= lengths[owner]
    return hashes[inside], owner[inside], at[inside]


def distinct_grams(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the distinct ``width``-character substrings of each text, by row."""
    hashes, owner, _ = joined_windows(texts, width)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first], owner[first]
