"""Structured Streaming over events: windows with watermarks, key segments, and a chunk sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chunkloom.functions import bits
from chunkloom.plans.planner import LEVELS
from chunkloom.sources.store import CHUNK_SCHEMA, Options, _physical, encode_table
from chunkloom.types import chunk_type


def windowed_sizes(stream: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Per window: rows, distinct-free sums and the bytes of value in base 128. Rows later than ``late`` are dropped."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    marked = stream.withWatermark(time, late)
    out = marked.groupBy(span).agg(F.count(F.lit(1)).alias("rows"), F.sum(bits.leb128_size(F.col(value))).cast("long").alias("varint_bytes"), F.max(key).alias("largest_key"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "rows", "varint_bytes", "largest_key")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Per key and session (rows less than gap apart): start, end, rows."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "rows")


def key_segments(stream: DataFrame, key: str, columns: list[str], flush_rows: int, time: str | None = None, late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """Segments of flush_rows rows of each key, in order of arrival: key, segment, n_rows, and arrays of the other columns.

    What a key has beyond its last full segment stays in the state, which is less than
    flush_rows rows. With a column ``time`` it is flushed as a shorter segment once the
    watermark (``late`` behind the newest row) has passed the key's last row by ``idle``;
    without one it stays until more arrives.
    """
    fields = [stream.schema[c] for c in columns]
    out = T.StructType([stream.schema[key], T.StructField("segment", T.LongType()), T.StructField("n_rows", T.LongType())] + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields if f.name != key])
    state = T.StructType([T.StructField("segment", T.LongType()), T.StructField("last_ms", T.LongType())] + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields if f.name != key])
    kept = [c for c in columns if c != key]
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    when = F.unix_millis(F.col(time)) if time else F.lit(0).cast("long")

    def flush(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        segment, last, *lists = held.get if held.exists else (0, 0, *([] for _ in kept))
        rows = [list(x) for x in lists]
        found: dict[str, list] = {f.name: [] for f in out.fields}

        def cut(n: int) -> None:
            nonlocal segment
            found[key].append(keys[0])
            found["segment"].append(segment)
            found["n_rows"].append(n)
            for at, c in enumerate(kept):
                found[c].append(rows[at][:n])
                rows[at] = rows[at][n:]
            segment += 1

        if held.hasTimedOut:
            if rows and rows[0]:
                cut(len(rows[0]))
            held.update((segment, last, *rows))
        else:
            for batch in batches:
                last = max(last, int(batch["_when"].max()))
                for at, c in enumerate(kept):
                    rows[at] += batch[c].tolist()
                while rows and len(rows[0]) >= flush_rows:
                    cut(flush_rows)
            held.update((segment, last, *rows))
            if time:
                held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(found)

    timed = stream.withWatermark(time, late) if time else stream
    rows = timed.select(key, *dict.fromkeys([*kept, *([time] if time else [])]), when.alias("_when"))
    return rows.groupBy(key).applyInPandasWithState(flush, out, state, "append", GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout)


def chunk_sink(path: str, order_by: list[str], **options: object) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: stores every micro-batch as chunks under path/epoch=<id>.

    An epoch that is run again replaces what it wrote, so each row is stored once.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        chosen = Options(**options).checked(batch.schema)
        names, types, level = batch.columns, [chunk_type(f).name for f in batch.schema.fields], LEVELS[chosen.profile]
        physical = _physical(batch).sortWithinPartitions(*order_by)

        def each(tables):  # noqa: ANN001, ANN202
            # numbers of batches differ between epochs and tasks
            first = (epoch << 40) + (TaskContext.get().partitionId() << 20)
            for number, rows in enumerate(tables):
                yield from encode_table(pa.Table.from_batches([rows]), names, types, level, first + number).to_batches()

        physical.mapInArrow(each, CHUNK_SCHEMA).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path.rstrip('/')}/epoch={epoch}")

    return store


def closing(stream: DataFrame, path: str, time: str, at: str) -> DataFrame:
    """The stream and one row, null but for its time, which moves the watermark past all others once what is there now is read.

    For tables that are read as one batch of a stream and then end.
    """
    spark = stream.sparkSession
    fields = [F.to_timestamp(F.lit(at)).cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    spark.range(1).select(*fields).write.mode("overwrite").parquet(path)
    return stream.unionByName(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))


def finished(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all that is there now, and returns what it appends as a table under path."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True)
    writer.start(f"{path}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
