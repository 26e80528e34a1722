"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch sent to a Python worker; long texts make batches heavy.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20

_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(sc, "_lexigrain_dir", None)
        if found is None:
            found = Path(tempfile.mkdtemp(prefix="lexigrain-")).as_uri()
            sc._lexigrain_dir = found
    return found


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches and makes the package importable in workers that were started elsewhere."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    on_path = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(":")] + [Path.cwd()]
    app = spark.sparkContext.applicationId
    if root in on_path or app in _shipped:
        return
    out = Path(tempfile.mkdtemp()) / "lexigrain.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in (root / "lexigrain").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            pass


atexit.register(_clean)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df into the shared folder as Parquet and returns the table read back.

    The files survive the loss of executors. They are deleted by release(), or at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigrain-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexigrain_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing lazy depends on it any more."""
    path = df._lexigrain_path
    _delete(df.sparkSession, path)
    _written[:] = [x for x in _written if x[1] != path]


def log(message: str) -> None:
    if os.environ.get("LEXIGRAIN_LOG"):
        print(message, file=sys.stderr, flush=True)
