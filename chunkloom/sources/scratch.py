"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from chunkloom.errors import InvalidOption

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: in the cluster's ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) a temporary folder is made; on
    a cluster no other machine could read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise InvalidOption("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="chunkloom-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = f"file://{_own[0]}"
    return f"{root.rstrip('/')}/chunkloom-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared scratch folder and reads it back.

    This cuts lineage: after the loss of an executor the table is read again
    instead of being computed again. The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.coalesce(partitions) if partitions else df
    out.write.option("compression", "zstd").parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read any more, before the application ends."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
