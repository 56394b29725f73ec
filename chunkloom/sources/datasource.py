"""``spark.read.format("chunkloom")`` and ``df.write.format("chunkloom")``.

Reads chunk tables file by file with pyarrow, one input partition a file; filters on
``partition_key`` of the key column and the option ``columns`` keep chunks from being
read. Paths are those that pyarrow's file systems open; tables elsewhere are read by
``store.read_store``, which leaves all reading to Spark.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage

from chunkloom import __version__
from chunkloom.errors import CorruptData, InvalidOption
from chunkloom.plans.planner import LEVELS
from chunkloom.sources.store import Options, _arrow_type, decode_table, encode_table
from chunkloom.types import chunk_type

_OPTIONS = {"strategy", "profile", "chunk_size_rows", "stream_id_column", "timestamp_column", "partition_key_column", "partition_flush_rows", "null_keys"}


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _meta(path: str) -> dict:
    fs, root = _open(path)
    for info in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/_table", allow_not_found=True)):
        if info.is_file and not info.base_name.startswith(("_", ".")):
            try:
                return json.loads(fs.open_input_stream(info.path).read())
            except ValueError as e:
                raise CorruptData(f"{path} holds no stored table: {e}") from e
    raise CorruptData(f"{path} holds no stored table")


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunkloom"

    def schema(self) -> T.StructType:
        full = T.StructType.fromJson(_meta(self.options["path"])["schema"])
        if columns := self.options.get("columns"):
            return T.StructType([full[c.strip()] for c in columns.split(",")])
        return full

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ChunkReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ChunkWriter(dict(self.options), schema, overwrite)


@dataclass
class FilePart(InputPartition):
    path: str
    key: int | None


class ChunkReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema_, self.key = path, schema, None
        meta = _meta(path)
        self.options = Options(**meta["options"])
        self.full = T.StructType.fromJson(meta["schema"])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (self.options.partition_key_column,) and self.options.strategy == "partitioned":
                self.key = f.value
            yield f  # Spark applies all of them again

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.path)
        files = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/chunks", recursive=True, allow_not_found=True))
        return [FilePart(i.path, self.key) for i in files if i.path.endswith(".parquet")] or [FilePart("", None)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _open(self.path)
        names = self.schema_.names
        series = (self.options.stream_id_column, self.options.timestamp_column) if self.options.strategy == "per_batch_relinearize" else None
        needed = list(dict.fromkeys([*names, *(series or ())]))
        wanted = [("column_name", "in", needed)] + ([("partition_key", "=", partition.key)] if partition.key is not None else [])
        with fs.open_input_file(partition.path) as file:
            table = pq.read_table(file, filters=wanted)
        keys = list(zip(table["batch_id"].to_pylist(), table["partition_key"].to_pylist(), strict=True))
        types = [_stored(f.dataType) for f in self.schema_.fields]
        for key in dict.fromkeys(keys):
            rows = table.take(pa.array([k for k, x in enumerate(keys) if x == key], pa.int64()))
            found = decode_table(rows, names, types, needed, series)
            out = pa.table([c.cast(_shown(f.dataType)) for c, f in zip(found.columns, self.schema_.fields, strict=True)], names=names)
            yield from out.to_batches()


def _stored(t: T.DataType) -> pa.DataType:
    name = t.simpleString()
    return pa.int64() if name.startswith("timestamp") else pa.int32() if name == "date" else _arrow_type(t)


def _shown(t: T.DataType) -> pa.DataType:
    name = t.simpleString()
    return {"timestamp": pa.timestamp("us", "UTC"), "timestamp_ntz": pa.timestamp("us"), "date": pa.date32()}.get(name) or _arrow_type(t)


@dataclass
class Written(WriterCommitMessage):
    path: str


class ChunkWriter(DataSourceArrowWriter):
    """Each task stores its rows in the order it gets them; repartition by the key first for ``partitioned``."""

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.path, self.schema_, self.overwrite = options["path"], schema, overwrite
        if unknown := {k.lower() for k in options} - _OPTIONS - {"path"}:
            raise InvalidOption(f"no such option: {', '.join(sorted(unknown))}")
        given = {k.lower(): v for k, v in options.items() if k.lower() in _OPTIONS}
        for name in ("chunk_size_rows", "partition_flush_rows"):
            if name in given:
                if not str(given[name]).isdigit():
                    raise InvalidOption(f"{name} is a number, not {given[name]}")
                given[name] = int(given[name])
        self.options = Options(**given).checked(schema)
        self.types = [chunk_type(f).name for f in schema.fields]
        fs, root = _open(self.path)
        there = fs.get_file_info(root).type != pyarrow.fs.FileType.NotFound
        if there and not overwrite and fs.get_file_info(f"{root}/_table").type != pyarrow.fs.FileType.NotFound:
            if Options(**_meta(self.path)["options"]) != self.options or _meta(self.path)["schema"] != schema.jsonValue():
                raise InvalidOption("the stored table has another schema or other options")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open(self.path)
        name = f"part-{uuid.uuid4().hex}"
        first = uuid.uuid4().int >> 80 << 12  # batches of different tasks must not share a number
        fs.create_dir(f"{root}/chunks", recursive=True)
        out, held, size, number = None, [], 0, 0
        limit, series = self.options.chunk_size_rows, (self.options.stream_id_column, self.options.timestamp_column) if self.options.strategy == "per_batch_relinearize" else None

        def physical(batch: pa.RecordBatch) -> pa.Table:
            return pa.table([c.cast(_stored(f.dataType)) for c, f in zip(batch.columns, self.schema_.fields, strict=True)], names=self.schema_.names)

        def cut(rows: pa.Table) -> Iterator[pa.Table]:
            nonlocal number
            key = self.options.partition_key_column if self.options.strategy == "partitioned" else None
            if key is None:
                yield encode_table(rows, self.schema_.names, self.types, LEVELS[self.options.profile], first + number, series=series)
                number += 1
                return
            values = rows[key].to_pylist()
            for k in dict.fromkeys(values):
                if k is None and self.options.null_keys == "drop":
                    continue
                some = rows.take(pa.array(np.flatnonzero([v == k for v in values])))
                for at in range(0, len(some), self.options.partition_flush_rows):
                    yield encode_table(some.slice(at, self.options.partition_flush_rows), self.schema_.names, self.types, LEVELS[self.options.profile], first + number, k, number)
                    number += 1

        def emit(rows: pa.Table) -> None:
            nonlocal out
            for made in cut(rows):
                out = out or pq.ParquetWriter(f"{root}/chunks/{name}.tmp", made.schema, filesystem=fs, compression="none")
                out.write_table(made)

        for batch in iterator:
            held.append(physical(batch))
            size += batch.num_rows
            while size >= limit:
                rows = pa.concat_tables(held)
                emit(rows.slice(0, limit))
                held, size = [rows.slice(limit)], size - limit
        if size:
            emit(pa.concat_tables(held))
        if out is not None:
            out.close()
        return Written(f"{root}/chunks/{name}" if out is not None else "")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        new = [m.path for m in messages if m and m.path]
        if self.overwrite:
            for info in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/chunks", allow_not_found=True)):
                if info.path.endswith(".parquet"):
                    fs.delete_file(info.path)
        for path in new:
            fs.move(f"{path}.tmp", f"{path}.parquet")
        fs.create_dir(f"{root}/_table", recursive=True)
        meta = {"schema": self.schema_.jsonValue(), "options": asdict(self.options), "writer": __version__, "version": 1}
        with fs.open_output_stream(f"{root}/_table/table.json") as file:
            file.write(json.dumps(meta).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m and m.path:
                fs.delete_file(f"{m.path}.tmp")


def register(spark) -> None:  # noqa: ANN001
    """Makes the format known to a session."""
    spark.dataSource.register(ChunkSource)
