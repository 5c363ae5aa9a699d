"""Arrow shards of bounded size, the dataset reader, and the embedding cache's manifest."""

import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from manyvec.sources import cache, shards

ROWS = "id long, text string, tags array<string>, v array<float>, at timestamp, part struct<a: int, b: string>"


def rows(spark, n=700, seed=1):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        text = None if i % 50 == 0 else "é" * rng.choice([0, 3, 300, 3000])
        made.append((i, text, [rng.choice("abc")] * (i % 3) if i % 7 else None, [0.5] * (i % 5), None, (i, "x" * (i % 9)) if i % 4 else None))
    return spark.createDataFrame(made, ROWS).repartition(5)


def stored_sizes(path):
    return {f: os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".arrow")}


@pytest.mark.parametrize("bound", [70_000, 200_000, 10**9])
def test_shards_stay_below_their_bound_and_hold_every_row(spark, tmp_path, bound):
    df, path = rows(spark), f"{tmp_path}/set"
    n = shards.save(df, f"file://{path}", "id", bound)
    sizes = stored_sizes(path)
    assert len(sizes) == n and max(sizes.values()) <= bound and (n == 1) == (bound == 10**9)
    assert sorted(sizes) == [f"data-{i:05d}-of-{n:05d}.arrow" for i in range(n)]
    back = shards.load(spark, f"file://{path}")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()


def test_shards_follow_the_key(spark, tmp_path):
    shards.save(rows(spark), f"file://{tmp_path}/set", "id", 70_000)
    last = -1
    for name in sorted(stored_sizes(f"{tmp_path}/set")):
        ids = pa.ipc.open_stream(pa.memory_map(f"{tmp_path}/set/{name}")).read_all().column("id").to_pylist()
        assert ids == list(range(last + 1, last + 1 + len(ids)))
        last = ids[-1]


def test_rows_of_over_half_the_bound_stand_alone(spark):
    df = spark.createDataFrame([(i, 10 if i % 10 else 80) for i in range(100)] + [(None, 500)], "id long, w long")
    placed = shards.assigned(df, "id", 100, F.col("w"))
    found = {r["shard"]: (r["n"], r["w"]) for r in placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    assert sum(n for n, _ in found.values()) == 101
    assert all(w <= 100 or n == 1 for n, w in found.values())
    assert sum(n == 1 and w >= 80 for n, w in found.values()) == 11
    assert shards.assigned(df.limit(0), "id", 100, F.col("w")).count() == 0


def test_reader_plans_by_batch_and_reads_named_columns(spark, tmp_path):
    df = rows(spark, 5000)
    shards.save(df, f"file://{tmp_path}/set", "id", 10**9)
    few = shards.load(spark, f"file://{tmp_path}/set", ["v", "id"], batches="2")
    assert few.columns == ["v", "id"] and few.rdd.getNumPartitions() >= 3
    assert few.agg(F.sum("id")).first()[0] == sum(range(5000))
    reader = shards.Folder({"path": f"{tmp_path}/set"}).reader(few.schema)
    opened = []
    real = shards._reader
    shards._reader = lambda source, columns=None: (opened.append(columns), real(source, columns))[1]
    try:
        batches = [b for p in reader.partitions() for b in reader.read(p)]
    finally:
        shards._reader = real
    assert [0, 3] in opened and sum(b.num_rows for b in batches) == 5000
    assert batches[0].schema.names == ["v", "id"]


def test_reader_of_random_access_files_splits_and_errors(spark, tmp_path):
    table = pa.table({"a": list(range(30)), "b": [f"t{i}" for i in range(30)]})
    for split, part in (("train", table.slice(0, 20)), ("test", table.slice(20))):
        os.makedirs(f"{tmp_path}/many/{split}")
        with pa.OSFile(f"{tmp_path}/many/{split}/x.arrow", "wb") as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(part, max_chunksize=7)
        json.dump({"_data_files": [{"filename": "x.arrow"}]}, open(f"{tmp_path}/many/{split}/state.json", "w"))
    json.dump({"splits": ["train", "test"]}, open(f"{tmp_path}/many/dataset_dict.json", "w"))
    assert sorted(r["a"] for r in shards.load(spark, f"{tmp_path}/many", ["a"], split="train", batches="1").collect()) == list(range(20))
    assert shards.load(spark, f"{tmp_path}/many", split="test").count() == 10
    for bad in ({"path": f"{tmp_path}/many"}, {"path": f"{tmp_path}/none"}):
        with pytest.raises(ValueError):
            shards.Folder(bad).files()
    with pytest.raises(ValueError):
        shards.save(rows(spark, 3), f"file://{tmp_path}/small", "id", 100)


def test_a_folder_without_its_list_is_no_dataset(spark, tmp_path):
    shards.save(rows(spark, 50), f"file://{tmp_path}/set", "id", 70_000)
    os.rename(f"{tmp_path}/set/state.json", f"{tmp_path}/set/other.json")
    with pytest.raises(ValueError):
        shards.Folder({"path": f"{tmp_path}/set"}).files()


def test_empty_datasets(spark, tmp_path):
    df = rows(spark, 5).limit(0)
    assert shards.save(df, f"file://{tmp_path}/set", "id") == 0
    back = shards.load(spark, f"file://{tmp_path}/set")
    assert back.count() == 0 and back.columns == df.columns


# the cache


PAGES = "page long, path string, toks array<array<double>>"


def pages(spark, n=6, tail=""):
    return spark.createDataFrame([(i, f"p{i}{tail}.png", [[float(i)]]) for i in range(n)] + [(None, None, None)], PAGES)


def test_cache_is_read_back_only_under_the_metadata_it_was_made_with(spark, tmp_path):
    held, key, meta = cache.EmbeddingCache(spark, f"file://{tmp_path}/c"), cache.Key("d", "clean"), {"model": "m1", "prompt": "Describe", "dtype": {"x": 1}}
    assert held.load(key, meta) is None
    calls = []
    encode = lambda: (calls.append(1), pages(spark))[1]
    first = held.load_or_encode(key, meta, encode, pages(spark))
    again = held.load_or_encode(key, {"prompt": "Describe", "dtype": {"x": 1}, "model": "m1"}, encode, pages(spark))
    assert calls == [1] and first.exceptAll(again).isEmpty() and again.count() == 7
    for changed in ({"model": "m2"}, {"prompt": "Other"}, {"more": 1}):
        with pytest.raises(cache.CacheMismatch, match=next(iter(changed))):
            held.load(key, meta | changed)
    with pytest.raises(cache.CacheMismatch, match="other pages"):
        held.load(key, meta, pages(spark, tail="x"))
    with pytest.raises(cache.CacheMismatch, match="expected"):
        held.load(key, meta, pages(spark, 5))
    assert held.load(cache.Key("d", "degraded", "blur"), meta) is None


def test_a_lost_job_leaves_the_partition_before_in_force(spark, tmp_path, monkeypatch):
    held, key = cache.EmbeddingCache(spark, f"file://{tmp_path}/c"), cache.Key("d", "clean")
    held.save(pages(spark), key, {"model": "m1"})
    monkeypatch.setattr(cache, "contents", lambda df: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        held.save(pages(spark, 2), key, {"model": "m2"})
    monkeypatch.undo()
    assert held.load(key, {"model": "m1"}).count() == 7
    held.save(pages(spark, 2), key, {"model": "m2"})
    assert held.load(key, {"model": "m2"}).count() == 3 and held.manifest().count() == 2 and held.unused().count() == 1


def test_changed_data_is_noticed(spark, tmp_path):
    held, key = cache.EmbeddingCache(spark, f"file://{tmp_path}/c"), cache.Key("d", "clean")
    held.save(pages(spark), key, {})
    folder = held.in_force().first()["folder"]
    pages(spark, 1).write.mode("append").parquet(f"file://{tmp_path}/c/data/{folder}")
    with pytest.raises(cache.CacheMismatch, match="no longer"):
        held.load(key, {})
    held.save(pages(spark).limit(0), cache.Key("e", "clean"), {})
    with pytest.raises(cache.CacheMismatch, match="empty"):
        held.load(cache.Key("e", "clean"), {})
