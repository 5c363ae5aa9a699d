"""Datasets in Arrow files: written in shards of bounded size, read back by record batch and column.

A folder holds ``data-00000-of-00012.arrow`` and so on in Arrow's stream format, ``dataset_info.json`` with the columns and
``state.json`` that lists the files; a folder of named splits has ``dataset_dict.json`` and a folder for each. Files in Arrow's
random-access format are read too. Paths may have any scheme that pyarrow opens; without one they are local.

Sizes: rows are taken in the order of a key and their bytes summed up to each row without a single-task window. With B the
bound less the longest ordinary row, a row that begins at byte s goes to shard s // B: a shard's rows begin within B bytes of
each other, so together they stay below the bound. A row of over half the bound is a shard of its own, numbered after the others;
only one that is longer than the bound by itself can make a larger shard."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from manyvec.operators.prefix import numbered, running_sum

#: What a file holds besides its rows: schema, messages of its batches, padding of their buffers.
FRAME = 16_384
BATCH_ROWS = 1000


def row_bytes(schema: T.StructType) -> Column:
    """At least what a row takes in an Arrow file: text and bytes as they are, nested values as JSON, and 16 bytes a column."""

    def of(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.NumericType, T.BooleanType)):
            return F.greatest(F.size(c), F.lit(0)) * 9
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(c)) * 4
        return F.octet_length(c) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(0)

    return sum((F.coalesce(of(f), F.lit(0)).cast("long") + 16 for f in schema.fields), F.lit(0).cast("long"))


def assigned(rows: DataFrame, key: str, bound: int, weight: Column) -> DataFrame:
    """Adds ``shard``: rows in the order of the numeric ``key``, no shard's weights adding up to more than ``bound``."""
    held = rows.withColumn("__w", weight)
    longest = held.agg(F.max(F.when(F.col("__w") <= bound // 2, F.col("__w"))).alias("m")).first()["m"] or 0
    step = bound - longest
    ordinary = running_sum(held.where(F.col("__w") <= bound // 2), key, F.col("__w"), "__e")
    ordinary = ordinary.withColumn("shard", F.floor((F.col("__e") - F.col("__w")) / F.lit(step)).cast("long")).drop("__e")
    if held.where(F.col("__w") > bound // 2).isEmpty():
        return ordinary.drop("__w")
    last = ordinary.agg(F.coalesce(F.max("shard"), F.lit(-1)).alias("n")).first()["n"]
    long_ones = numbered(held.where(F.col("__w") > bound // 2), key, "__n").withColumn("shard", F.col("__n") + last).drop("__n")
    return ordinary.unionByName(long_ones).drop("__w")


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _written(path: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> None:
    """One file, first under another name, so that a lost or repeated task leaves nothing half-written under this one."""
    files, place = opened(path)
    aside = f"{posixpath.dirname(place)}/.{uuid.uuid4().hex}"
    with files.open_output_stream(aside) as out, pa.ipc.new_stream(out, schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    files.move(aside, place)


def save(rows: DataFrame, path: str, key: str, bound: int = 200 << 20) -> int:
    """Writes ``rows`` in shards of at most ``bound`` bytes and returns their number. The list of files is written last:
    a folder without it is no dataset."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if bound < 4 * FRAME:
        raise ValueError(f"a shard has at least {4 * FRAME} bytes")
    columns, schema = rows.columns, to_arrow_schema(rows.schema)
    placed = assigned(rows, key, bound - FRAME, row_bytes(rows.schema))
    files, place = opened(path)
    files.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's shards, one after the other: its rows are sorted by shard."""
        for shard, lots in _runs(batches):
            _written(f"{path}/{shard:05d}.arrow", schema, (pa.RecordBatch.from_arrays([lot.column(c).cast(schema.field(c).type) for c in columns], schema=schema) for lot in lots))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64())})

    arranged = placed.repartition("shard").sortWithinPartitions("shard", key)
    shards = sorted(r["shard"] for r in arranged.mapInArrow(run, "shard long").collect())  # a number a shard
    names = []
    for i, shard in enumerate(shards):
        names.append(f"data-{i:05d}-of-{len(shards):05d}.arrow")
        files.move(f"{place}/{shard:05d}.arrow", f"{place}/{names[-1]}")
    if not shards:
        names = ["data-00000-of-00001.arrow"]
        _written(f"{path}/{names[0]}", schema, iter(()))
    info = {"features": {f.name: {"dtype": str(f.type), "_type": "Value"} for f in schema}}
    state = {"_data_files": [{"filename": n} for n in names], "_fingerprint": uuid.uuid4().hex[:16], "_format_columns": None, "_format_kwargs": {}, "_format_type": None, "_output_all_columns": False, "_split": None}
    for name, content in (("dataset_info.json", info), ("state.json", state)):
        with files.open_output_stream(f"{place}/{name}") as out:
            out.write(json.dumps(content, indent=2).encode())
    return len(shards)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(shard, its batches of bounded size) from batches sorted by shard; each shard is read to its end before the next."""

    def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            of, at = batch.column("shard").to_pylist(), 0
            while at < batch.num_rows:
                end = at + 1
                while end < batch.num_rows and of[end] == of[at] and end - at < BATCH_ROWS:
                    end += 1
                yield of[at], batch.slice(at, end - at)
                at = end

    for shard, own in groupby(pieces(), key=lambda x: x[0]):
        yield shard, (piece for _, piece in own)


@dataclass
class Batches(InputPartition):
    """Record batches ``first`` to ``first + n`` of a file; ``n`` = -1 is all that follow."""

    path: str
    first: int
    n: int


class Folder(DataSource):
    """Spark's reader of such folders: ``spark.read.format("arrow_folder").load(path)``; option ``split`` names a split,
    ``batches`` how many record batches a partition has at most. A schema that is given selects columns, and only their
    buffers are read."""

    @classmethod
    def name(cls) -> str:
        return "arrow_folder"

    def files(self) -> list[str]:
        root = self.options["path"].rstrip("/")
        if "split" in self.options:
            root = f"{root}/{self.options['split']}"
        found = _json(f"{root}/state.json")
        if found is None:
            splits = _json(f"{root}/dataset_dict.json")
            raise ValueError(f"name one of the splits {splits['splits']}" if splits else f"no dataset in {root}")
        return [f"{root}/{f['filename']}" for f in found["_data_files"]]

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        with _source(self.files()[0]) as source:
            return from_arrow_schema(_reader(source).schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FolderReader(self.files(), schema, int(self.options.get("batches", "64")))


def _json(path: str):
    files, place = opened(path)
    try:
        with files.open_input_stream(place) as source:
            return json.loads(source.read())
    except FileNotFoundError:
        return None


def _source(path: str):
    """A file opened for reading; local ones are mapped, so batches that are passed over are not read."""
    files, place = opened(path)
    return pa.memory_map(place) if type(files).__name__ == "LocalFileSystem" else files.open_input_file(place)


def _reader(source, columns: list[int] | None = None):
    """A reader of either format."""
    options = pa.ipc.IpcReadOptions(included_fields=columns) if columns else None
    magic = source.read(6)
    source.seek(0)
    return pa.ipc.open_file(source, options=options) if magic == b"ARROW1" else pa.ipc.open_stream(source, options=options)


class FolderReader(DataSourceReader):
    def __init__(self, files: list[str], schema: T.StructType, batches: int):
        self.files, self.schema, self.batches = files, schema, max(1, batches)

    def partitions(self) -> list[Batches]:
        """By record batch where a file tells or shows their number cheaply; else a file each."""
        out = []
        for path in self.files:
            with _source(path) as source:
                reader = _reader(source)
                if hasattr(reader, "num_record_batches"):
                    n = reader.num_record_batches
                elif isinstance(source, pa.MemoryMappedFile):
                    n = sum(1 for _ in reader)
                else:
                    out.append(Batches(path, 0, -1))
                    continue
            out += [Batches(path, i, min(self.batches, n - i)) for i in range(0, n, self.batches)]
        return out or [Batches(self.files[0], 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        with _source(partition.path) as source:
            there = _reader(source).schema
            if lost := [n for n in wanted.names if n not in there.names]:
                raise ValueError(f"no columns {lost} in {partition.path}")
            source.seek(0)
            reader = _reader(source, sorted(there.get_field_index(n) for n in wanted.names))
            for batch in self._batches(reader, partition):
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in wanted], schema=wanted)

    @staticmethod
    def _batches(reader, partition: Batches) -> Iterator[pa.RecordBatch]:
        if hasattr(reader, "num_record_batches"):
            yield from (reader.get_batch(i) for i in range(partition.first, partition.first + partition.n))
            return
        for i, batch in enumerate(reader):
            if 0 <= partition.n <= i - partition.first:
                return
            if i >= partition.first:
                yield batch


def load(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """A dataset from its folder; ``columns`` are the ones that are read."""
    spark.dataSource.register(Folder)
    reader = spark.read.format("arrow_folder").options(**options)
    if columns is not None:
        whole = Folder({"path": path, **options}).schema()
        reader = reader.schema(T.StructType([whole[c] for c in columns]))
    return reader.load(path)
