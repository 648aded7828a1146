"""Reading corpora in several formats and writing them without ever leaving half a result."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

_PARQUET, _JSONL = {"parquet"}, {"jsonl", "json", "jsonl_gzip", "jsonl.gz", "json.gz", "gzip"}


def read_corpus(spark: SparkSession, path: str | list[str], kind: str, columns: list[str] | None = None, schema: str | T.StructType | None = None, strict: bool = True) -> DataFrame:
    """Read ``parquet``, (gzip) JSON lines or CSV; only the wanted columns are scanned.

    Strict reading fails on the first malformed record; tolerant JSON reading keeps it in
    ``_corrupt`` with null fields. A missing column is an error before any data is read.
    """
    kind = kind.lower()
    if kind in _PARQUET:
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    elif kind in _JSONL:
        if schema is None:
            raise ValueError("JSON lines are read with a schema")
        struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
        if not strict:
            struct = T.StructType([*struct.fields, T.StructField("_corrupt", T.StringType())])
            reader = reader.option("columnNameOfCorruptRecord", "_corrupt")
        df = reader.schema(struct).json(path)
    elif kind == "csv":
        # a line with another number of columns is malformed; without pruning every column is looked at to tell
        df = spark.read.schema(schema).option("columnPruning", "false").csv(path, header=True, mode="FAILFAST" if strict else "DROPMALFORMED")
    else:
        raise ValueError(f"unknown format {kind!r}")
    missing = set(columns or []) - set(df.columns)
    if missing:
        raise ValueError(f"columns not in the data: {sorted(missing)}")
    return df.select(*columns) if columns else df


def with_location(df: DataFrame) -> DataFrame:
    """Adds where each row was read: ``source_file`` and ``row_index`` within it (parquet) for provenance."""
    return df.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("row_index"))


def json_line_report(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """One row: lines, blank, invalid UTF-8, invalid JSON, not an object, a required field missing, empty ``required[0]``.

    Lines are read as bytes, so that a line in another encoding is counted as such instead of being patched.
    """
    utf8 = F.is_valid_utf8(F.col("value"))
    v = F.when(utf8, F.col("value"))
    blank = F.trim(v) == ""
    keys = F.json_object_keys(v)
    parsed = F.try_parse_json(v)
    missing = F.size(F.array_except(F.array(*map(F.lit, required)), F.coalesce(keys, F.array().cast("array<string>")))) > 0
    first = F.get_json_object(v, f"$.{required[0]}")
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(blank).alias("blank"), F.count_if(~utf8).alias("invalid_utf8"), F.count_if(utf8 & ~blank & parsed.isNull()).alias("invalid_json"),
        F.count_if(~blank & parsed.isNotNull() & keys.isNull()).alias("not_object"), F.count_if(~blank & keys.isNotNull() & missing).alias("missing_field"), F.count_if(~blank & keys.isNotNull() & ~missing & (F.trim(F.coalesce(first, F.lit(""))) == "")).alias("empty"),
    )


def missing_fields(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns the table doesn't have."""
    return sorted(set(required) - set(df.columns))


def expand_files(pattern: str) -> list[str]:
    """Files a local glob names, sorted, each once; none is an error."""
    import glob

    found = sorted({os.path.realpath(p) for p in glob.glob(pattern) if os.path.isfile(p)})
    if not found:
        raise FileNotFoundError(pattern)
    return found


def object_uri(root: str, name: str) -> str:
    """Absolute URIs and paths stand as they are; other names are below ``root``."""
    return name if "://" in name or name.startswith("/") else f"{root.rstrip('/')}/{name}"


def write_new(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Write a result that must not exist yet; Spark's commit protocol leaves all of it (with ``_SUCCESS``) or nothing readable."""
    writer = df.write.mode("errorifexists")
    if by:
        writer = writer.partitionBy(*by)
    writer.format(kind).save(path)


def write_shards(df: DataFrame, path: str, shards: int, *order) -> None:
    """Round-robin shards in the given order, as ``shard=k`` folders with ``line_number``; provenance columns stay in the rows."""
    from ..operators.budget import ranked

    rows = ranked(df, "_place", *order)
    rows = rows.withColumn("shard", F.col("_place") % shards).withColumn("line_number", F.expr(f"_place div {shards}") + 1).drop("_place")
    write_new(rows.repartition(shards, "shard").sortWithinPartitions("shard", "line_number"), path, by=["shard"])


def write_report(report: dict, path: str) -> None:
    """A small JSON report, on whatever file system the path names: written beside, then moved into place."""
    shared.write_text(path, json.dumps(report, sort_keys=True, ensure_ascii=False, indent=1))


def fingerprint(df: DataFrame, *columns: str) -> str:
    """SHA-256 over counts and order-free sums of row hashes: equal tables give equal fingerprints however they are partitioned."""
    h = F.xxhash64(*(columns or df.columns))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("a"), F.sum(F.pmod(F.shiftrightunsigned(h, 31), F.lit(1 << 31))).alias("b")).first()
    import hashlib

    return hashlib.sha256(f"{r.n}|{r.a}|{r.b}|{','.join(columns or df.columns)}".encode()).hexdigest()


def reusable(report_path: str, inputs: str, rows: int | None = None) -> dict | None:
    """The report of an earlier run, if it is complete and was made from the same inputs (and gave as many rows, if said)."""
    try:
        report = json.loads(shared.read_text(report_path) or "")
    except ValueError:
        return None
    same = report.get("status") == "done" and report.get("inputs") == inputs and (rows is None or report.get("rows") == rows)
    return report if same else None


def publish(gates: DataFrame, report: dict, folder: str) -> bool:
    """Write the report, then the ``_SUCCESS`` marker only if every gate passed; an old marker goes first."""
    marker = f"{folder}/_SUCCESS"
    shared.delete(marker)
    failed = [r.gate for r in gates.filter(~F.col("passed")).select("gate").collect()]  # a few gates
    write_report(report | {"failed_gates": failed, "status": "done" if not failed else "failed"}, f"{folder}/report.json")
    if not failed:
        shared.write_text(marker, "")
    return not failed
