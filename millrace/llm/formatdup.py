"""Records that differ in formatting only: Merkle digests of normalised nested records.

Leaves are normalised (letters and digits of ``content``, case-folded; other
values as they stand), a node's digest is made from its children's, with the
children of an object in no order, and records are grouped by root digest. Only
keys and digests are shuffled for that; the canonical records of groups of two or
more then move once to be compared in full with the first of their group.
"""

from __future__ import annotations

import json
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import map_columns
from ..functions.unicode import letters_digits
from ..operators.skew import join_groups
from ..runtime import written

DIGEST_BYTES = 16
#: The bitmap of digests has at most this many bits (as a power of 2).
MOST_BITS = 27
#: Members of a class that are compared with its first record in one part.
PART_ROWS = 1_000


def _hash(tag: bytes, *parts: bytes) -> bytes:
    h = blake2b(tag, digest_size=DIGEST_BYTES)
    for part in parts:
        h.update(len(part).to_bytes(8, "big"))
        h.update(part)
    return h.digest()


def normalised(value, loose: frozenset[str], key: str | None = None):
    """The record with the values under ``loose`` keys reduced to letters and digits, null fields left out."""
    if isinstance(value, dict):
        kept = {k: normalised(v, loose, k) for k, v in value.items()}
        return {k: v for k, v in kept.items() if v is not None}
    if isinstance(value, list):
        return [normalised(v, loose, key) for v in value]
    if key in loose:
        return letters_digits(value) if value is None or isinstance(value, str) else value
    return value


def merkle(value) -> bytes:
    """Digest of a normalised record, bottom up; fields of an object have no order, items of a list do."""
    if isinstance(value, dict):
        return _hash(b"object", *sorted(_hash(b"field", k.encode("utf-8", "surrogatepass"), merkle(v)) for k, v in value.items()))
    if isinstance(value, list):
        return _hash(b"list", *map(merkle, value))
    if isinstance(value, str):
        return _hash(b"text", value.encode("utf-8", "surrogatepass"))
    return _hash(b"value", json.dumps(value).encode())


def conversation(payload: str | None):
    """The messages of a stored conversation, or None if there is no readable list of messages."""
    try:
        messages = json.loads(payload)["conversations"]
    except (TypeError, ValueError, KeyError):
        return None
    if not isinstance(messages, list) or not all(isinstance(m, dict) for m in messages):
        return None
    return [{"content": None} | m for m in messages]


def canonical_record(key: str, payload: str | None, loose: frozenset[str]):
    """The normalised messages of a payload; what isn't a readable conversation is a record that equals only itself."""
    messages = conversation(payload)
    if messages is None:
        return {"unreadable": payload, "key": key}
    canon = normalised(messages, loose)
    for m in canon:
        m.setdefault("content", "")
    return canon


def fingerprints(records: DataFrame, key: str, payload: str, loose: tuple[str, ...] = ("content",)) -> DataFrame:
    """``(key, digest)`` for each record with a key: the root digest of the normalised record."""
    loose_keys = frozenset(loose)

    def run(keys: list, payloads: list) -> dict:
        return {key: keys, "digest": [merkle(canonical_record(k, t, loose_keys))[:DIGEST_BYTES] for k, t in zip(keys, payloads)]}

    return map_columns(_records(records, key, payload), run, f"{key} string, digest binary")


def _records(records: DataFrame, key: str, payload: str) -> DataFrame:
    return records.select(F.col(key).cast("string").alias(key), F.col(payload).alias(payload)).filter(F.col(key).isNotNull())


def _marks(several: DataFrame) -> tuple[int, np.ndarray]:
    """A bitmap of the first bits of the digests given: at most 16 MB, whatever their number."""
    bits = min(MOST_BITS, max(10, (several.count() * 16).bit_length()))
    slots = several.select(F.expr(f"cast(conv(hex(substring(digest, 1, 4)), 16, 10) as long) div {1 << (32 - bits)}").alias("slot"))
    words = slots.select(F.expr("slot div 32").alias("word"), F.expr("shiftleft(1L, cast(slot % 32 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[words["word"].to_numpy()] = words["bit"].to_numpy().astype(np.uint32)
    return bits, out


def _canonicals(records: DataFrame, key: str, payload: str, several: DataFrame, loose: tuple[str, ...]) -> DataFrame:
    """``(key, digest, canonical)`` of the records whose digest may be among those given (none of them is missing)."""
    loose_keys = frozenset(loose)
    shared = records.sparkSession.sparkContext.broadcast(_marks(several))

    def run(keys: list, payloads: list) -> dict:
        bits, marks = shared.value
        out: dict = {key: [], "digest": [], "canonical": []}
        for k, text in zip(keys, payloads):
            canon = canonical_record(k, text, loose_keys)
            digest = merkle(canon)[:DIGEST_BYTES]
            slot = int.from_bytes(digest[:4], "big") >> (32 - bits)
            if marks[slot >> 5] >> np.uint32(slot & 31) & np.uint32(1):
                for name, value in zip(out, (k, digest, json.dumps(canon, sort_keys=True, ensure_ascii=True))):
                    out[name].append(value)
        return out

    return map_columns(_records(records, key, payload), run, f"{key} string, digest binary, canonical string")


def copies(records: DataFrame, key: str = "candidate_id", payload: str = "payload_json", loose: tuple[str, ...] = ("content",)) -> DataFrame:
    """``(key, first, copies)``: for each record the smallest key among its copies and their number.

    Rows with the same key and record (delivered twice) count as one. Input may
    have any other columns; rows with a null key are left out. A record alone in
    its class has copies = 1 and is its own first; so is one whose payload is
    null, broken or holds no list of messages. Empty tables give an empty result.

    Classes of any size are safe: digests are counted with map-side combine,
    members meet the first of their class in parts of at most about PART_ROWS
    rows, and nothing of a class is gathered. Should two different records share
    a digest, those unlike the first are grouped by the record itself.
    """
    marked = written(fingerprints(records, key, payload, loose).dropDuplicates([key, "digest"]))
    classes = written(marked.groupBy("digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies")))
    alone = classes.filter("copies = 1").select(F.col("first").alias(key), "first", "copies")
    several = classes.filter("copies > 1")
    of = join_groups(marked, several, ["digest"], "copies", marked.count())
    parts = F.expr(f"cast((copies + {PART_ROWS - 1}) div {PART_ROWS} as int)")
    full = written(_canonicals(records, key, payload, several, loose).join(of, [key, "digest"]).withColumn("part", F.pmod(F.xxhash64(key), parts).cast("int")))
    heads = full.filter(F.col(key) == F.col("first")).dropDuplicates(["digest"]).select("digest", F.col("canonical").alias("head"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    same = F.col("canonical") == F.col("head")
    compared = written(full.join(heads, ["digest", "part"]).select(key, "digest", "first", "copies", same.alias("same"), F.when(~same, F.col("canonical")).alias("canonical")).distinct())
    odd = compared.filter("not same")
    unlike = odd.groupBy("digest").agg(F.countDistinct(key).alias("unlike"))
    alike = compared.filter("same").join(unlike, "digest", "left").select(key, "first", (F.col("copies") - F.coalesce("unlike", F.lit(0))).alias("copies"))
    others = odd.groupBy("digest", "canonical").agg(F.min(key).alias("first"), F.countDistinct(key).alias("copies"))
    rest = odd.select(key, "digest", "canonical").join(others, ["digest", "canonical"]).select(key, "first", "copies")
    return alone.unionByName(alike).unionByName(rest)


def collapsed(records: DataFrame, key: str = "candidate_id", payload: str = "payload_json") -> DataFrame:
    """One row for each distinct record, ``(key, copies)``; the key is the smallest of its copies."""
    return copies(records, key, payload).filter(F.col(key) == F.col("first")).select(key, "copies")


def copy_pairs(records: DataFrame, key: str = "candidate_id", payload: str = "payload_json") -> DataFrame:
    """``(key_a, key_b)``: the smallest key of each class of copies with each of the others in turn."""
    found = copies(records, key, payload).filter(F.col(key) != F.col("first"))
    return found.select(F.col("first").alias(f"{key}_a"), F.col(key).alias(f"{key}_b")).distinct()
