"""Rows of differing shape: nested lookups, nested files, source adapters, preference pairs, paths in trees."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- nested values, as JSON text


def nested(record: Column, path: str) -> Column:
    """``struct(value, present)`` of a dotted path in a record stored as JSON: a field that is there may well be null."""
    found = F.try_parse_json(record)
    at = "$." + path
    return F.struct(F.try_variant_get(found, at, "string").alias("value"), F.coalesce(F.try_variant_get(found, at, "variant").isNotNull(), F.lit(False)).alias("present"))


def first_present(scopes: list[Column], fields: tuple[str, ...]) -> Column:
    """``struct(value, present)`` of the first of the fields that is present, each looked for in all scopes before the next."""
    every = F.array(*(nested(scope, field) for field in fields for scope in scopes))
    missing = F.struct(F.lit(None).cast("string").alias("value"), F.lit(False).alias("present"))
    return F.coalesce(F.get(F.filter(every, lambda x: x["present"]), F.lit(0)), missing)


def language_value(value: Column) -> Column:
    """A language that is text or a record with ``name``, ``language`` or ``id``: trimmed, lower case, two common aliases; empty if there is none."""
    record = F.try_parse_json(value)
    part = lambda k: F.nullif(F.try_variant_get(record, f"$.{k}", "string"), F.lit(""))
    text = F.when(F.startswith(F.ltrim(value), F.lit("{")) & record.isNotNull(), F.coalesce(part("name"), part("language"), part("id"))).otherwise(value)
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(low == "c++", "cpp").when(low == "c#", "csharp").otherwise(low)


#: Keys under which a licence record names the licence (fixed values), the first that has one counts.
LICENSE_KEYS = ("spdx_id", "spdx", "license", "name", "id")


def license_names(value) -> list[str]:
    """Every licence in a value: text (also JSON in text, or names parted by comma, semicolon or bar), a record, or a list of such."""
    if isinstance(value, str):
        text = value.strip()
        if text[:1] in ("[", "{"):
            try:
                return license_names(json.loads(text))
            except ValueError:
                pass
        return [part.strip() for part in re.split("[,;|]", text) if part.strip()]
    if isinstance(value, dict):
        named = next((value[k] for k in LICENSE_KEYS if value.get(k)), None)
        return license_names(named) if named else [x for v in value.values() for x in license_names(v)]
    if isinstance(value, list):
        return [x for v in value for x in license_names(v)]
    return [] if value is None else [str(value)]


#: Folders of code that others wrote (fixed values).
VENDOR_PARTS = ("node_modules", "third_party", "third-party", "vendor", "vendors")


def in_vendor_path(path: Column) -> Column:
    """One of the path's parts, however the slashes lean, is a vendor folder; false for a missing path."""
    return F.coalesce(F.arrays_overlap(F.split(F.lower(path), r"[\\/]+"), F.array(*map(F.lit, VENDOR_PARTS))), F.lit(False))


def exploded(rows: DataFrame, key: str, items: Column, keep, text) -> DataFrame:
    """``(key, item_index, text)``: one row for each nested item that ``keep(item)`` holds for, at its place in the row; rows without items give none."""
    return rows.select(key, F.posexplode(items).alias("item_index", "item")).filter(keep(F.col("item"))).select(key, "item_index", text(F.col("item")).alias("text"))


# ---- source adapters

#: Per source shape: field of the instruction, field that goes on with it and the label before it, field of the answer, and what stands before all (fixed values).
ADAPTERS = {
    "alpaca_zh": ("instruction", "input", "\n\n输入：\n", "output", ""),
    "alpaca_suffix_zh": ("instruction_zh", "input_zh", "\n\n输入：\n", "output_zh", ""),
    "question_answer": ("question", None, "", "answer", ""),
    "instruction_response": ("instruction", None, "", "response", ""),
    "alpaca_en": ("instruction", "input", "\n\nInput:\n", "output", ""),
    "program": ("text", "test_list", "\n\nYour solution must pass these tests:\n", "code", ""),
    "context_response": ("instruction", "context", "\n\nContext:\n", "response", ""),
    "article_summary": ("article", None, "", "highlights", "Summarize the following news article faithfully and concisely.\n\nArticle:\n"),
}


def adapted(shape: str, field) -> Column:
    """The conversation of a row of one shape: user and assistant message; ``field(name)`` is the row's column of that name."""
    first, more, label, last, before = ADAPTERS[shape]
    clean = lambda c: F.coalesce(F.trim(c), F.lit(""))
    prompt = F.concat(F.lit(before), clean(field(first)))
    if more:
        extra = clean(field(more))
        prompt = F.concat(prompt, F.when(extra != "", F.concat(F.lit(label), extra)).otherwise(F.lit("")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("user", prompt), message("assistant", clean(field(last))))


# ---- preference pairs


def squeezed(c: Column) -> Column:
    """Lower case, each blank run one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def pair_reason(chosen: Column, rejected: Column, least: int = 12) -> Column:
    """Why two conversations are no preference pair, or null: the first of context_mismatch, short_prompt, schema, identical_answers."""
    last = lambda c: F.element_at(c, -1)
    said = lambda c: F.coalesce(last(c)["content"], F.lit(""))
    context = lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    whole = lambda c: (last(c)["role"] == "assistant") & (F.trim(said(c)) != "")
    return (
        F.when((F.size(chosen) != 2) | (F.size(rejected) != 2) | (context(chosen) != context(rejected)), "context_mismatch")
        .when(F.length(squeezed(F.coalesce(F.element_at(chosen, 1)["content"], F.lit("")))) < least, "short_prompt")
        .when(~whole(chosen) | ~whole(rejected), "schema")
        .when(squeezed(said(chosen)) == squeezed(said(rejected)), "identical_answers")
    )


def pair_targets(chosen: Column, rejected: Column, tokens, most: int) -> Column:
    """``struct(prefix, chosen_targets, rejected_targets, reason)``: tokens of the shared context and of either answer, and why the pair can't be used, if so."""
    count = lambda c, k: F.size(tokens(F.coalesce(F.element_at(c, k)["content"], F.lit(""))))
    prefix, good, bad = count(chosen, 1), count(chosen, -1), count(rejected, -1)
    reason = F.when(prefix + F.greatest(good, bad) > most, "overlength").when((good == 0) | (bad == 0), "zero_targets")
    return F.struct(prefix.alias("prefix"), good.alias("chosen_targets"), bad.alias("rejected_targets"), reason.alias("reason"))


# ---- trees


def best_paths(nodes: DataFrame, node: str, parent: str, role: str, order: list[Column], most: int = 31) -> DataFrame:
    """``(root, length, leaf)``: from each node without a parent down to the best child (first in ``order``) while roles alternate, at most ``most`` steps.

    The best child of every node is one aggregate; the walk is a bounded loop of
    joins of the roots' current ends with it, so no tree is gathered.
    """
    from ..runtime import cut

    child = F.struct(*order, F.col(node).alias("_id"), F.col(role).alias("_role"))
    best = cut(nodes.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_at")).agg(F.min(child).alias("_c")).select("_at", F.col("_c._id").alias("_next"), F.col("_c._role").alias("_next_role")))
    ends = nodes.filter(F.col(parent).isNull()).select(F.col(node).alias("root"), F.lit(1).cast("long").alias("length"), F.col(node).alias("leaf"), F.col(role).alias("_role")).distinct()
    done = None
    for _ in range(most):
        ends = cut(ends.join(best, F.col("leaf") == F.col("_at"), "left"))
        goes = F.col("_next").isNotNull() & ~F.col("_next_role").eqNullSafe(F.col("_role"))
        rest = ends.filter(~goes).select("root", "length", "leaf")
        done = rest if done is None else done.unionByName(rest)
        ends = ends.filter(goes).select("root", (F.col("length") + 1).alias("length"), F.col("_next").alias("leaf"), F.col("_next_role").alias("_role"))
        if ends.isEmpty():
            return done
    return done.unionByName(ends.select("root", "length", "leaf"))


LICENSES = T.ArrayType(T.StringType())
