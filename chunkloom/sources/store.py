"""Stored tables: a Parquet table of chunks with their plans, and a sidecar that describes the whole.

A chunk is a row, so the manifest is a DataFrame: column pruning and key or batch
filters are filters on rows that Parquet statistics prune. Layouts: ``none`` keeps
the order, ``per_batch_relinearize`` sorts values by series within a batch, but for
columns that this makes larger, and ``partitioned`` deals rows out by a key, in segments.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom import __version__
from chunkloom.errors import CorruptData, InvalidOption
from chunkloom.operators import layout
from chunkloom.operators.order import BATCH_ROWS, batched, numbered
from chunkloom.plans import chunk as chunks
from chunkloom.plans.planner import LEVELS
from chunkloom.types import TYPES, chunk_type

STRATEGIES = ("none", "per_batch_relinearize", "partitioned")
CHUNK_SCHEMA = (
    "batch_id long, column_idx int, column_name string, partition_key long, segment long, num_rows long, null_count long, original_type string, "
    "plan_json string, streams map<string,binary>, raw_bytes long, compressed_bytes long, min_value double, max_value double, by_series boolean"
)
_ARROW_CHUNKS = pa.schema(
    [
        ("batch_id", pa.int64()), ("column_idx", pa.int32()), ("column_name", pa.string()), ("partition_key", pa.int64()), ("segment", pa.int64()), ("num_rows", pa.int64()), ("null_count", pa.int64()),
        ("original_type", pa.string()), ("plan_json", pa.string()), ("streams", pa.map_(pa.string(), pa.binary())), ("raw_bytes", pa.int64()), ("compressed_bytes", pa.int64()), ("min_value", pa.float64()), ("max_value", pa.float64()), ("by_series", pa.bool_()),
    ]
)


#: Segments whose chunks leave a task together, and bytes of chunks beyond which fewer do.
_TOGETHER, _TOGETHER_BYTES = 64, 4 << 20


@dataclass(frozen=True)
class Options:
    """How a table is stored; values as users write them, any case."""

    strategy: str = "none"
    profile: str = "balanced"
    chunk_size_rows: int = BATCH_ROWS
    stream_id_column: str | None = None
    timestamp_column: str | None = None
    partition_key_column: str | None = None
    partition_flush_rows: int = BATCH_ROWS
    null_keys: str = "keep"

    def checked(self, schema: T.StructType) -> Options:
        out = Options(**{**asdict(self), "strategy": self.strategy.lower(), "profile": self.profile.lower(), "null_keys": self.null_keys.lower()})
        if out.strategy not in STRATEGIES:
            raise InvalidOption(f"strategy is one of {', '.join(STRATEGIES)}, not {self.strategy}")
        if out.profile not in LEVELS:
            raise InvalidOption(f"profile is one of {', '.join(LEVELS)}, not {self.profile}")
        if out.chunk_size_rows < 1 or out.partition_flush_rows < 1:
            raise InvalidOption("batches and segments have a row or more")
        needed = {"per_batch_relinearize": ("stream_id_column", "timestamp_column"), "partitioned": ("partition_key_column",)}.get(out.strategy, ())
        for name in needed:
            column = getattr(out, name)
            if column is None:
                raise InvalidOption(f"{out.strategy} needs {name}")
            if column not in schema.names:
                raise InvalidOption(f"{name}: no column {column}")
            if chunk_type(schema[column]).kind not in ("signed", "unsigned"):
                raise InvalidOption(f"{name}: {column} must be an integer or a time")
        return out


def _physical(df: DataFrame) -> DataFrame:
    """Dates as days and timestamps as microseconds; everything else as it is."""
    columns = []
    for f in df.schema.fields:
        chunk_type(f)
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind == "date":
            c = F.unix_date(c)
        elif kind == "timestamp":
            c = F.unix_micros(c)
        elif kind == "timestamp_ntz":
            c = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', `{f.name}`)")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def _logical(df: DataFrame, schema: T.StructType) -> DataFrame:
    columns = []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind == "date":
            c = F.date_from_unix_date(c)
        elif kind == "timestamp":
            c = F.timestamp_micros(c)
        elif kind == "timestamp_ntz":
            c = F.expr(f"timestampadd(MICROSECOND, `{f.name}`, timestamp_ntz'1970-01-01')")
        columns.append(c.alias(f.name, metadata=f.metadata))
    return df.select(*columns)


def _span(array: pa.Array) -> tuple[float | None, float | None]:
    """Smallest and largest value as doubles, rounded outwards, so that they bound the values; NaN is left out."""
    some = array.drop_null()
    if pa.types.is_boolean(some.type):
        some = some.cast(pa.uint8())
    if pa.types.is_floating(some.type):
        some = some.filter(pc.invert(pc.is_nan(some)))
    if not len(some):
        return None, None
    lo, hi = (x.as_py() for x in pc.min_max(some).values())
    a, b = float(lo), float(hi)
    return (np.nextafter(a, -np.inf) if a > lo else a), (np.nextafter(b, np.inf) if b < hi else b)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal integer keys (nulls are equal too), of rows that are sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            valid = batch[key].is_valid().to_numpy(zero_copy_only=False)
            values = batch[key].fill_null(0).to_numpy(zero_copy_only=False)
            new |= (values[1:] != values[:-1]) | (valid[1:] != valid[:-1])
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for at, end in zip(edges, edges[1:], strict=False):
            own = tuple(batch[key][at].as_py() for key in keys)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def _size(chunk: chunks.Chunk) -> int:
    return sum(map(len, chunk.streams.values()))


def encode_table(rows: pa.Table, names: list[str], types: list[str], level: int, batch_id: int, key: int | None = None, segment: int | None = None, series: tuple[str, str] | None = None) -> pa.Table:
    """The chunks of one batch; with series (stream, time) every other column is put into that order if that makes it smaller."""
    order = pc.sort_indices(rows.append_column("_at", pa.array(np.arange(len(rows)))), [(series[0], "ascending"), (series[1], "ascending"), ("_at", "ascending")], null_placement="at_start") if series else None
    out: dict[str, list] = {c: [] for c in _ARROW_CHUNKS.names}
    for k, (name, kind) in enumerate(zip(names, types, strict=True)):
        column = rows[name].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
        if TYPES[kind].kind == "unsigned":
            raw = TYPES[kind].unsigned
            array = pa.array(column.to_numpy(zero_copy_only=False) if not column.null_count else column.fill_null(0).to_numpy(zero_copy_only=False)).cast(pa.int64())
            values = array.to_numpy().astype(np.int64).astype(raw.dtype)
            column = pa.array(values, mask=column.is_null().to_numpy(zero_copy_only=False)) if column.null_count else pa.array(values)
        made, by_series = chunks.encode_values(column, level), None
        if order is not None and name not in series:
            other = chunks.encode_values(column.take(order), level)
            by_series = _size(other) < _size(made)
            made = other if by_series else made
        lo, hi = _span(column)
        size = _size(made)
        row = (batch_id, k, name, key, segment, len(column), column.null_count, kind, json.dumps(made.plan, separators=(",", ":")), list(made.streams.items()), TYPES[kind].width * len(column), size, lo, hi, by_series)
        for c, x in zip(out, row, strict=True):
            out[c].append(x)
    return pa.table({c: pa.array(out[c], _ARROW_CHUNKS.field(c).type) for c in out}, schema=_ARROW_CHUNKS)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over all shuffle partitions: coding costs far more than its bytes tell, by which small ones would be merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def encoded(df: DataFrame, options: Options, order_by: list[str]) -> DataFrame:
    """The chunk table of df; order_by is the total order that the rows have."""
    options = options.checked(df.schema)
    names, types, level = df.columns, [chunk_type(f).name for f in df.schema.fields], LEVELS[options.profile]
    physical = _physical(df)
    if options.strategy == "partitioned":
        key = options.partition_key_column
        rows = numbered(physical, order_by)
        rows = rows.where(F.col(key).isNotNull()) if options.null_keys == "drop" else rows
        rows = layout.salted_segments(rows, key, options.partition_flush_rows).withColumn("_key", F.col(key).cast("long"))

        def each_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: list[pa.Table] = []
            for group in runs(batches, ["_key", "segment"]):
                key_, segment = group["_key"][0].as_py(), group["segment"][0].as_py()
                made.append(encode_table(group, names, types, level, segment, key_, segment))
                if len(made) == _TOGETHER or sum(t.nbytes for t in made) > _TOGETHER_BYTES:
                    yield from pa.concat_tables(made).combine_chunks().to_batches()
                    made = []
            if made:
                yield from pa.concat_tables(made).combine_chunks().to_batches()

        # a segment is never larger than partition_flush_rows, so a key of any size is spread over tasks
        return _spread(rows, "_key", "segment").sortWithinPartitions("_key", "segment", "pos").mapInArrow(each_task, CHUNK_SCHEMA)
    series = (options.stream_id_column, options.timestamp_column) if options.strategy == "per_batch_relinearize" else None

    def each_batch(group: pa.Table) -> pa.Table:
        group = group.sort_by([("row_idx", "ascending")])
        return encode_table(group, names, types, level, group["batch_id"][0].as_py(), series=series)

    return _spread(batched(physical, order_by, options.chunk_size_rows), "batch_id").groupBy("batch_id").applyInArrow(each_batch, CHUNK_SCHEMA)


def _chunk(row: dict) -> chunks.Chunk:
    try:
        return chunks.Chunk(row["num_rows"], row["original_type"], json.loads(row["plan_json"]), dict(row["streams"]))
    except (TypeError, ValueError) as e:
        raise CorruptData(f"chunk {row['batch_id']}/{row['column_idx']}: {e}") from e


def decode_table(rows: pa.Table, names: list[str], types: list[pa.DataType], needed: list[str], series: tuple[str, str] | None) -> pa.Table:
    """One batch's chunks as the wanted columns."""
    listed = rows.to_pylist()
    found = {r["column_name"]: chunks.decode_values(_chunk(r)) for r in listed}
    if missing := [n for n in needed if n not in found]:
        raise CorruptData(f"no chunk of {', '.join(missing)}")
    if len({len(a) for a in found.values()}) > 1:
        raise CorruptData("chunks of one batch have different lengths")
    if series:
        at = pa.array(np.arange(len(found[series[0]])))
        order = pc.sort_indices(pa.table({"s": found[series[0]], "t": found[series[1]], "a": at}), [("s", "ascending"), ("t", "ascending"), ("a", "ascending")], null_placement="at_start")
        back = np.empty(len(order), np.int64)
        back[order.to_numpy()] = np.arange(len(order))
        # tables written before columns could keep their order have no such mark
        as_arrived = {*series, *(r["column_name"] for r in listed if r.get("by_series") is False)}
        found = {n: a if n in as_arrived else a.take(pa.array(back)) for n, a in found.items()}
    out = {}
    for n, t in zip(names, types, strict=True):
        a = found[n]
        if pa.types.is_uint64(a.type):
            bits = a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64).view(np.int64)
            a = pa.array(bits, mask=a.is_null().to_numpy(zero_copy_only=False))
        out[n] = a.cast(t)
    return pa.table(out)


def _meta_path(path: str) -> str:
    return f"{path.rstrip('/')}/_table"


def _chunk_path(path: str) -> str:
    return f"{path.rstrip('/')}/chunks"


def write_store(df: DataFrame, path: str, order_by: list[str], mode: str = "error", **options: object) -> None:
    """Stores df at path. Options: those of ``Options``. Columns of other types than the eleven, dates and times are an error."""
    chosen = Options(**options).checked(df.schema)
    made = encoded(df, chosen, order_by)
    # chunks are coded already; the order of rows lets statistics prune by key and batch
    made.sortWithinPartitions("partition_key", "batch_id", "column_idx").write.mode(mode).option("compression", "uncompressed").parquet(_chunk_path(path))
    write_description(df.sparkSession, path, df.schema, chosen, mode)


def write_description(spark: SparkSession, path: str, schema: T.StructType, options: Options, mode: str = "error") -> None:
    """The sidecar of a stored table."""
    meta = {"schema": schema.jsonValue(), "options": asdict(options), "writer": __version__, "version": 1}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(mode).text(_meta_path(path))


def describe_store(spark: SparkSession, path: str) -> dict:
    """Schema, options and version of a stored table."""
    found = [r["value"] for r in spark.read.text(_meta_path(path)).collect()]
    try:
        (meta,) = map(json.loads, found)
        if meta["version"] != 1:
            raise CorruptData(f"version {meta['version']} is not known")
        return meta
    except (ValueError, KeyError, TypeError) as e:
        raise CorruptData(f"{path} holds no stored table: {e}") from e


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row per chunk, without its data: sizes, plans, spans. Reads no streams."""
    return spark.read.parquet(_chunk_path(path)).drop("streams")


def read_store(spark: SparkSession, path: str, columns: list[str] | None = None, key: int | None = None, between: tuple[str, float, float] | None = None) -> DataFrame:
    """The stored rows.

    columns: only these are read and decoded. key: only this partition. between: a
    column and two bounds; batches whose span lies outside are not read, and the others
    still hold all their rows.
    """
    meta = describe_store(spark, path)
    schema, options = T.StructType.fromJson(meta["schema"]), Options(**meta["options"])
    wanted = columns or schema.names
    if unknown := [c for c in wanted if c not in schema.names]:
        raise InvalidOption(f"no column {', '.join(unknown)}")
    series = (options.stream_id_column, options.timestamp_column) if options.strategy == "per_batch_relinearize" else None
    needed = list(dict.fromkeys([*wanted, *(series or ())]))
    table = spark.read.schema(CHUNK_SCHEMA).parquet(_chunk_path(path))
    if key is not None:
        if options.strategy != "partitioned":
            raise InvalidOption("the table is not partitioned")
        table = table.where(F.col("partition_key") == key)
    if between is not None:
        name, lo, hi = between
        inside = spark.read.schema(CHUNK_SCHEMA).parquet(_chunk_path(path)).where((F.col("column_name") == name) & (F.col("max_value") >= lo) & (F.col("min_value") <= hi)).select(F.col("batch_id").alias("_b"), F.col("partition_key").alias("_p"))
        table = table.join(inside, (F.col("batch_id") == F.col("_b")) & F.col("partition_key").eqNullSafe(F.col("_p")), "left_semi")
    table = table.where(F.col("column_name").isin(needed))
    fields = [schema[c] for c in wanted]
    physical = T.StructType([T.StructField(f.name, T.LongType() if f.dataType.simpleString().startswith("timestamp") else T.IntegerType() if f.dataType.simpleString() == "date" else f.dataType) for f in fields])
    arrow = [_arrow_type(f.dataType) for f in physical.fields]

    def decode(group: pa.Table) -> pa.Table:
        return decode_table(group, wanted, arrow, needed, series)

    rows = _spread(table, "batch_id", "partition_key").groupBy("batch_id", "partition_key").applyInArrow(decode, physical)
    return _logical(rows, T.StructType(fields))


def _arrow_type(t: T.DataType) -> pa.DataType:
    return {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_()}[t.simpleString()]


def partition_keys(spark: SparkSession, path: str) -> DataFrame:
    """partition_key, rows of a partitioned table, from the manifest alone."""
    if describe_store(spark, path)["options"]["strategy"] != "partitioned":
        raise InvalidOption("the table is not partitioned")
    return read_manifest(spark, path).where("column_idx = 0").groupBy("partition_key").agg(F.sum("num_rows").alias("rows"))


def size_report(chunk_table: DataFrame) -> DataFrame:
    """Per column: chunks, rows, raw and encoded bytes, their ratio, and the most frequent pipeline."""
    by_plan = chunk_table.groupBy("column_name", "plan_json").agg(F.count(F.lit(1)).alias("n"), F.sum("num_rows").alias("rows"), F.sum("raw_bytes").alias("raw"), F.sum("compressed_bytes").alias("small"))
    out = by_plan.groupBy("column_name").agg(
        F.sum("n").alias("chunks"), F.sum("rows").alias("rows"), F.sum("raw").alias("raw_bytes"), F.sum("small").alias("encoded_bytes"), F.max(F.struct("n", "plan_json")).alias("top")
    )
    return out.select("column_name", "chunks", "rows", "raw_bytes", "encoded_bytes", (F.col("encoded_bytes") / F.col("raw_bytes")).alias("ratio"), F.col("top.plan_json").alias("usual_plan"))
