"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job relies on: UTC for all time arithmetic, AQE for runtime
# re-planning (partition coalescing, skew-join splitting, broadcast conversion).
DEFAULT_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(
    master: str | None = None,
    *,
    app_name: str = "fraudstream",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster, ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in DEFAULT_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder on storage that the driver and every executor reach.

    It is the session's ``spark.checkpoint.dir``; where only
    ``SparkContext.setCheckpointDir`` was called, the context's folder. A local
    session with neither (tests) gets a temporary folder; a cluster without one
    is an error, because a machine-local folder would lose data there.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="fraudstream-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return "/".join([base.rstrip("/"), *parts]) if parts else base


def session_key(spark: SparkSession) -> str:
    """A name of this session that no other one gets, for caches of what was derived in it."""
    key = spark.conf.get("fraudstream.session", None)
    if key is None:
        key = uuid.uuid4().hex
        spark.conf.set("fraudstream.session", key)
    return key


def run_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder under :func:`shared_dir`, deleted when the session's JVM ends.

    For intermediate tables of one run: their readers are lazy frames of this
    session, so they can not be deleted earlier.
    """
    path = shared_dir(spark, kind, uuid.uuid4().hex)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the Python workers, once for each context.

    Needed where it is not installed on the executors; they fetch it from the driver.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="fraudstream-")) / "fraudstream-src.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(packed))
    _shipped.add(sc.applicationId)
