"""Packing texts into sequences of fixed capacity: the sum-of-squares rule.

Every item goes to the open sequence (or a new one) after which the sum, over
all gaps g, of the squared number of open sequences with gap g is smallest.
Texts are measured in tokens of a public tokenizer.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_columns
from ..runtime import written

CAPACITY = 768
#: About as many items are packed in one task.
GROUP_ITEMS = 50_000
#: Sequences that are filled less than this are opened again and packed anew across groups.
REOPEN_BELOW = 0.97


def default_tokenizer() -> tuple[str, str]:
    """Path of a public vocabulary file and its splitting pattern, if the package with them is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("millrace", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``(doc_id, n_tokens)`` of every text; the vocabulary file (about 1 MB) is read once and broadcast."""
    path, pattern = tokenizer or default_tokenizer()
    with open(path, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast((f.read(), pattern))

    def measure(ids: list, texts: list) -> dict:
        encoding = _encoding(*shared.value)
        return {"doc_id": ids, "n_tokens": [len(encoding.encode_ordinary(t)) for t in texts]}

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text <> ''")
    return map_columns(rows, measure, "doc_id long, n_tokens long").filter("n_tokens > 0")


def sum_of_squares(sizes: list[int], capacity: int) -> list[int]:
    """The sequence of each item, in the order they come; sizes from 1 to ``capacity``.

    Placing an item of size s into a sequence with gap g changes the sum by
    2 (N(g - s) - N(g)) + 2, or by 2 N(capacity - s) + 1 for a new one, where
    closed sequences (gap 0) don't count; ties go to the smallest gap.
    """
    n = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, count = [], 0
    for s in sizes:
        change = 2 * n[: capacity - s + 1] - 2 * n[s:] + 2
        change[0] -= 1 + 2 * n[0]  # the sequence becomes full: it leaves the sum
        change[n[s:] == 0] = np.iinfo(np.int64).max
        fresh = 2 * n[capacity - s] + 1 if s < capacity else 0
        left = int(np.argmin(change))
        if change[left] <= fresh:
            gap = left + s
            k = open_at[gap].pop()
            n[gap] -= 1
        else:
            left, k = capacity - s, count
            count += 1
        if left:
            open_at[left].append(k)
            n[left] += 1
        out.append(k)
    return out


_ITEM = "struct<doc_id: long, piece_index: long, n_tokens: long>"
_SCHEMA = f"group_id long, bin long, documents array<{_ITEM}>, used long"


def _packed(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """Pack each group of items (of bounded size, spread by hash) in one task."""
    import pyarrow as pa

    def pack(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("n_tokens", "doc_id", "piece_index"))), key=lambda r: (-r[0], r[1], r[2]))
        bins: dict[int, list[dict]] = {}
        for k, (n, d, p) in zip(sum_of_squares([r[0] for r in rows], capacity), rows):
            bins.setdefault(k, []).append({"doc_id": d, "piece_index": p, "n_tokens": n})
        group = table["g"][0].as_py()
        kept = sorted(bins)
        item = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece_index", pa.int64()), ("n_tokens", pa.int64())]))
        return pa.table({"group_id": pa.array([group] * len(kept), pa.int64()), "bin": pa.array(kept, pa.int64()), "documents": pa.array([bins[k] for k in kept], item), "used": pa.array([sum(x["n_tokens"] for x in bins[k]) for k in kept], pa.int64())})

    spread = items.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece_index"), F.lit(groups)))
    return spread.groupBy("g").applyInArrow(pack, _SCHEMA)


def pack_sizes(sizes: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``(sequence_id, documents, used, capacity)`` from ``(doc_id, n_tokens)``.

    An item larger than the capacity is cut into full sequences and a rest, which
    is packed like any item; no other item is split. ``documents`` lists
    ``doc_id, piece_index, n_tokens``. Repeated rows count once; sizes that are
    null or less than 1 take no room and are left out. Groups of about
    ``group_items`` items are packed independently, then what is badly filled
    in them is packed anew across groups, so no task holds more than a bounded
    number of items and the room lost doesn't grow with the number of groups.
    That is the same for any number of groups, one included.
    """
    items = written(sizes.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long")).filter("doc_id is not null and n_tokens > 0").distinct())
    full = items.filter(F.col("n_tokens") >= capacity)
    whole = full.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n_tokens div {capacity}") - 1)).alias("piece_index"))
    whole = whole.select(
        F.concat(F.lit("f-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece_index").cast("string")).alias("sequence_id"),
        F.array(F.struct("doc_id", "piece_index", F.lit(capacity).cast("long").alias("n_tokens"))).alias("documents"),
        F.lit(capacity).cast("long").alias("used"),
    )
    rest = items.select("doc_id", F.expr(f"n_tokens div {capacity}").alias("piece_index"), F.expr(f"n_tokens % {capacity}").alias("n_tokens")).filter("n_tokens > 0")
    count = rest.count()
    groups = max(1, -(-count // group_items))
    packed = written(_packed(rest, groups, capacity))
    poor = packed.filter(F.col("used") < REOPEN_BELOW * capacity).select(F.explode("documents").alias("d")).select("d.*")
    again = _packed(poor, max(1, -(-poor.count() // group_items)), capacity).withColumn("round", F.lit("b"))
    packed = packed.filter(F.col("used") >= REOPEN_BELOW * capacity).withColumn("round", F.lit("a")).unionByName(again)
    named = packed.select(F.concat_ws("-", "round", F.col("group_id").cast("string"), F.col("bin").cast("string")).alias("sequence_id"), "documents", "used")
    return whole.unionByName(named).withColumn("capacity", F.lit(capacity).cast("long"))


def sequences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """Measure the texts and pack them; see :func:`pack_sizes`. Null and empty texts have no tokens and are left out."""
    return pack_sizes(token_sizes(documents, doc_id, text, tokenizer), capacity)


def fill(packed: DataFrame) -> DataFrame:
    """``(sequences, least_sequences, tokens, room, filled)``: one row that says how well the sequences are filled.

    No packing needs fewer than ``least_sequences``, the tokens over the capacity rounded up.
    """
    sums = packed.agg(F.count(F.lit(1)).alias("sequences"), F.ceil(F.sum("used") / F.max("capacity")).alias("least_sequences"), F.sum("used").alias("tokens"), F.sum("capacity").alias("room"))
    return sums.withColumn("filled", F.col("tokens") / F.col("room"))
