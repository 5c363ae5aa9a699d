import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from manyvec.operators.scoring import score_multi_vector
from manyvec.sources import tables as S
from manyvec.streaming.scoring import score_stream


def png(path, h=2, w=3):
    pixels = b"".join(b"\0" + bytes((10 * y + x, 100 + x, 200) [i] for x in range(w) for i in range(3)) for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b""))


def test_images_and_page_paths(spark, tmp_path):
    for n in (1, 2, 3):
        png(tmp_path / f"page_{n:03d}.png")
        png(tmp_path / f"page_{n:03d}_GN_JC.png")
    png(tmp_path / "page_001_PD.png")
    assert [r[0] for r in S.list_variants(spark, str(tmp_path)).collect()] == ["GN_JC", "PD"]
    found = S.page_paths(spark, str(tmp_path), "GN_JC", pages=3, max_docs=2).orderBy("page").collect()
    assert [r["page"] for r in found] == [0, 1] and found[0]["path"].endswith("page_001_GN_JC.png")
    with pytest.raises(FileNotFoundError):
        S.page_paths(spark, str(tmp_path), None, pages=4)
    row = S.read_images(spark, str(tmp_path / "page_001.png")).collect()[0]
    assert (row["h"], row["w"], row["c"]) == (2, 3, 3) and list(row["data"][:6]) == [0, 100, 200, 1, 101, 200]


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([(0, "a.png", [[1.0]]), (1, "b.png", [[2.0]])], "page long, path string, toks array<array<double>>")
    calls = []

    def encode():
        calls.append(1)
        return rows

    for _ in range(2):
        assert S.cached(spark, path, "d", "single", None, encode, rows).count() == 2
    S.save_cache(rows.limit(1), path, "d", "single", "GN")
    assert len(calls) == 1 and S.load_cache(spark, path, "d", "single", None).count() == 2
    with pytest.raises(ValueError):
        S.load_cache(spark, path, "other", "single", None)
    with pytest.raises(ValueError):
        S.load_cache(spark, path, "d", "single", None, rows.withColumn("path", F.lit("z")))
    plan = spark.read.parquet(path).where("variant = 'GN'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(variant" in plan


def test_tables_datasets_and_results(spark, tmp_path):
    for name in S.CORPUS_TABLES:
        spark.range(3).write.parquet(str(tmp_path / "root" / name))
    assert {n: d.count() for n, d in S.load_tables(spark, str(tmp_path / "root")).items()} == dict.fromkeys(S.CORPUS_TABLES, 3)
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"a": 1}\n{"a": 2}\n')
    assert S.load_dataset(spark, str(lines), "json", "a long").agg(F.sum("a")).collect()[0][0] == 3
    assert S.load_splits(spark, {"p": str(tmp_path / "root/corpus"), "q": str(tmp_path / "root/qrels")}).where("dataset = 'q'").count() == 3
    assert S.first_sample(S.dummy_dataset(spark)).collect()[0]["query"] == "query 0"
    S.save_results(spark.createDataFrame([(0.5, 2)], "ndcg double, n_queries long"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).collect()[0]["ndcg"] == 0.5
    S.save_shards(spark.range(10).coalesce(1), str(tmp_path / "s"), 4)
    assert len(list((tmp_path / "s").glob("part-*.parquet"))) == 3
    build = lambda: spark.createDataFrame([("train", "PD")], "split string, variant string")
    for _ in range(2):
        assert S.load_or_build_manifest(spark, str(tmp_path / "m"), "split string, variant string", build).collect()[0]["variant"] == "PD"
    ids = spark.createDataFrame([([3, 1, 2],)], "ids array<long>").select(S.id_list(S.id_list_line(F.col("ids"))).alias("ids"))
    assert ids.collect()[0]["ids"] == [3, 1, 2]
    assert json.dumps(S.sanitized({1: {2, 1}, "p": object})).startswith('{"1": [1, 2]')


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, [[float(i), 1.0]]) for i in range(6)], "pid long, toks array<array<double>>")
    docs.write.parquet(str(tmp_path / "in"))
    queries = spark.createDataFrame([(0, [[1.0, 0.0], [0.0, 1.0]])], "qid long, toks array<array<double>>")
    stream = score_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), queries, 3.0)
    run = stream.writeStream.format("memory").queryName("scored").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    want = score_multi_vector(queries, docs).where("score >= 3")
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, want.collect()))
