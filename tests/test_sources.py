import gzip
import os

import pytest
from pyspark.sql import functions as F

from millrace import runtime
from millrace.operators.quantiles import exact_quantiles
from millrace.sources import files, shared


def test_gzip_lines_csv_and_locations(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"text": "one", "n": 1}\n{"text": null, "n": 2}\n')
    got = files.read_corpus(spark, str(tmp_path / "a.jsonl.gz"), "jsonl_gzip", ["n"], schema="text string, n long")
    assert sorted(r.n for r in got.collect()) == [1, 2] and got.columns == ["n"]
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3\n5,6\n")
    assert files.read_corpus(spark, str(tmp_path / "t.csv"), "csv", schema="a int, b int", strict=False).count() == 2
    with pytest.raises(Exception):
        files.read_corpus(spark, str(tmp_path / "t.csv"), "csv", schema="a int, b int").collect()
    assert files.expand_files(str(tmp_path / "*.csv")) == [str(tmp_path / "t.csv")]
    with pytest.raises(FileNotFoundError):
        files.expand_files(str(tmp_path / "none*"))
    assert files.object_uri("/data/", "x/y") == "/data/x/y" and files.object_uri("/data", "s3a://b/k") == "s3a://b/k" and files.object_uri("/data", "/abs") == "/abs"
    assert files.missing_fields(got, ["n", "text"]) == ["text"]


def test_lines_that_are_no_text(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'{"text": "a"}\n\n{"text": ""}\n{"text": "\xff"}\n[1]\nno\n{"n": 1}\n')
    r = files.json_line_report(spark, str(tmp_path / "x.jsonl"), ["text"]).first()
    assert (r.lines, r.blank, r.invalid_utf8, r.invalid_json, r.not_object, r.missing_field, r.empty) == (7, 1, 1, 1, 1, 1, 1)


def test_reports_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/deep/report.json"
    files.write_report({"status": "done", "inputs": "1", "rows": 5}, path)
    files.write_report({"status": "done", "inputs": "2", "rows": 6}, path)
    assert files.reusable(path, "2", 6)["rows"] == 6 and files.reusable(path, "2", 5) is None and files.reusable(path, "1") is None
    assert [n for n in os.listdir(tmp_path / "deep") if not n.endswith(".crc")] == ["report.json"]
    (tmp_path / "broken.json").write_text("{")
    assert files.reusable(f"{tmp_path}/broken.json", "1") is None and shared.read_text(f"{tmp_path}/none") is None


def test_written_tables_are_released(spark):
    df = runtime.written(spark.range(5))
    path = runtime._TABLES[-1]
    assert df.count() == 5 and shared.exists(path)
    runtime.release(spark)
    assert not shared.exists(path) and runtime._TABLES == []


def test_quantiles_by_rank(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, (F.pmod(F.xxhash64("id"), F.lit(500)) / 7.0)).alias("v")).unionByName(spark.createDataFrame([(9, 2.5)], "g long, v double"))
    wanted = {"a": ("disc", 0.5), "b": ("disc", 1.0), "c": ("cont", 0.37), "d": ("rounded", 0.9), "e": ("floor", 0.0)}
    got = {r.g: r for r in exact_quantiles(rows, ["g"], "v", wanted).collect()}
    for g in (0, 1, 2, 9):
        v = sorted(r.v for r in rows.filter(F.col("g") == g).collect() if r.v is not None)
        n, h = len(v), (len(v) - 1) * 0.37
        want = (v[max(0, -(-n // 2) - 1)], v[-1], v[int(h)] + (v[min(n - 1, int(-(-h // 1)))] - v[int(h)]) * (h - int(h)), v[round((n - 1) * 0.9)], v[0])
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[g][1:], want)), (g, got[g], want)
    assert exact_quantiles(rows.limit(0), ["g"], "v", wanted).count() == 0
