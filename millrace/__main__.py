"""Command line: ``python -m millrace data|evaluate|audit|query ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .plans import load
from .plans.registry import QUERIES
from .runtime import release
from .sources import files


def prepare(spark: SparkSession, source: str, output: str, limit: int) -> None:
    """JSON lines with ``text`` or ``prompt`` and ``response`` become rows of words and labels; the output must not exist."""
    rows = files.read_corpus(spark, source, "jsonl", schema="text string, prompt string, response string")
    prompt, reply = X.words(F.coalesce("prompt", F.lit(""))), X.words(F.coalesce("response", "text"))
    labels = F.when(F.col("response").isNull(), F.slice(reply, 1, limit)).otherwise(F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), F.size(prompt)), reply), 1, limit))
    rows = rows.select(F.slice(F.concat(prompt, reply), 1, limit).alias("tokens"), labels.alias("labels"))
    bad = F.size(F.filter("labels", lambda x: x.isNotNull())) == 0
    files.write_new(rows.withColumn("tokens", F.when(bad, F.raise_error(F.lit("a row has no supervised token"))).otherwise(F.col("tokens"))), output, "json")


def evaluate(spark: SparkSession, source: str) -> None:
    """Token-weighted mean loss and perplexity of rows with ``loss`` and ``n_tokens``."""
    rows = files.read_corpus(spark, source, "jsonl", schema="loss double, n_tokens long")
    nll = F.sum(F.col("loss") * F.col("n_tokens")) / F.sum("n_tokens")
    rows.agg(nll.alias("nll"), F.sum("n_tokens").alias("tokens")).withColumn("perplexity", F.when(F.col("nll") < 700, F.exp("nll"))).show(truncate=False)


def main() -> None:
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    data = commands.add_parser("data", help="turn JSON lines into token rows")
    data.add_argument("source")
    data.add_argument("output")
    data.add_argument("--max-length", type=int, default=768)
    commands.add_parser("evaluate", help="token-weighted loss").add_argument("source")
    run = commands.add_parser("query", help="run a registered query over a data directory")
    run.add_argument("name")
    run.add_argument("directory")
    run.add_argument("--output", help="parquet folder to write; without it the first rows are shown")
    commands.add_parser("audit", help="size and duplicate gates over a data directory").add_argument("directory")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    load()
    if args.command == "data":
        prepare(spark, args.source, args.output, args.max_length)
    elif args.command == "evaluate":
        evaluate(spark, args.source)
    elif args.command == "audit":
        QUERIES["a30_quality_gates"](spark, args.directory).show(truncate=False)
    else:
        result = QUERIES[args.name](spark, args.directory)
        files.write_new(result, args.output) if args.output else result.show(truncate=False)
    release(spark)


if __name__ == "__main__":
    main()
