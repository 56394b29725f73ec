"""Sends this library to the executors of a session that can't import it themselves, and bounds what goes to Python at once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Bytes of rows that go to a Python worker at once, where the session leaves Spark's own bound.
BATCH_BYTES = 4 << 20
_BOUND, _SPARKS = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"


def ship(spark: SparkSession) -> None:
    """Adds the library's sources to the session's Python files, once for each application, and sets the bound of batches."""
    if spark.conf.get(_BOUND, _SPARKS) == _SPARKS:
        spark.conf.set(_BOUND, f"{BATCH_BYTES}b")
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parents[1]
    if app in _sent or not root.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="chunkloom-ship-")) / "chunkloom-lib.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)
