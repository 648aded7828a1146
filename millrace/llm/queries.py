"""The queries of the training-text operations, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import formatdup, leakage, mixing, overlap, packing, pairs, spans, splitting


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "candidates"), table(spark, d, "raw_pairs"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_counts(table(spark, d, "candidates"), table(spark, d, "raw_pairs"))


def _chunk_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, d, name) for name in ("train_chunks", "validation_chunks", "candidates"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(*_chunk_tables(spark, d))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_counts(*_chunk_tables(spark, d), table(spark, d, "pretrain_records"))


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return overlap.linked_prompts(table(spark, d, "candidates"))


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    return overlap.prompt_members(table(spark, d, "candidates"))


def p2_weighted(spark: SparkSession, d: str) -> DataFrame:
    return overlap.similar_prompts(table(spark, d, "candidates"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    records = mixing.pretrain_units(table(spark, d, "pretrain_records"))
    listed = table(spark, d, "sources").select(mixing.unit_name(F.col("source_id")).alias("unit_id")).distinct()
    return records.join(listed, "unit_id", "left_semi").unionByName(mixing.candidate_units(table(spark, d, "candidates")))


def p3_uses(spark: SparkSession, d: str) -> DataFrame:
    return mixing.uses(_units(spark, d), table(spark, d, "mix_targets"))


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_units(spark, d), table(spark, d, "mix_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.split_long(table(spark, d, "pretrain_records"), limit=3000, overlap=200)
    return cut.filter("piece_index = 0 and n_pieces > 1").select(F.col("piece_of").alias("candidate_id")).distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_long(table(spark, d, "pretrain_records"), limit=3000, overlap=200)


def p4_joined(spark: SparkSession, d: str) -> DataFrame:
    """Every text cut and joined again: its digest and whether all pieces keep the limit."""
    whole = splitting.joined(p4_pieces(spark, d))
    return whole.select(F.col("piece_of").alias("candidate_id"), F.sha2("text", 256).alias("text_sha256"), (F.col("longest") <= 3000).alias("within_limit"))


def p4_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).groupBy("boundary").agg(F.count(F.lit(1)).alias("pieces"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.copy_pairs(table(spark, d, "candidates"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formatdup.collapsed(table(spark, d, "candidates"))


def p6_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.sequences(table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.sequences(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_reference"))
    return found.select("item_id", "doc_id").distinct()


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_reference"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return leakage.without_leaks(documents, leakage.leaked_runs(documents, table(spark, d, "eval_reference")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"), length=200)


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.spans(table(spark, d, "documents"), length=200)


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"), length=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        *(p1_found, p1_counts, p2_found, p2_counts, p2_links, p2_members, p2_weighted, p3_uses, p3_shares, p4_found, p4_pieces, p4_joined, p4_boundaries, p5_found, p5_collapsed),
        *(p6_sequences, p6_fill, p7_found, p7_leaks, p7_clean, p8_found, p8_spans, p8_shared),
    )
}
