"""What every operator needs of a Spark session: code on the executors, a shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from modspark.errors import InvalidOption

ARROW_BYTES = str(8 << 20)
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def build(app: str = "modspark", cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once for each Spark context.

    Python workers import it from the zip that Spark's own file server deals out,
    so no executor needs a checkout or a folder shared with the driver. Arrow batches get
    a bound in bytes that keeps what a worker holds small, unless the session has its own.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == "67108864":  # the default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="modspark-"), "modspark_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("modspark", os.path.relpath(path, top)))
    context.addPyFile(to)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where it is unset and the master is local."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local"):
        raise InvalidOption("spark.checkpoint.dir must name a folder that all executors see")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="modspark-shared-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back.

    This cuts the lineage at a copy that outlives any executor and that is computed
    once, however often it is read. The folder goes when the driver's process ends,
    or with release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/modspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted like the tables of materialise()."""
    path = f"{shared_dir(spark)}/modspark-{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def held() -> frozenset[str]:
    """Paths of what materialise() and scratch() have given out and that is still there."""
    return frozenset(path for _, path in _written)


def release(paths: frozenset[str] | None = None) -> None:
    """Delete tables that materialise() has written, all of them unless paths are given; frames over them end with it."""
    for spark, path in list(_written):
        if paths is not None and path not in paths:
            continue
        _written.remove((spark, path))
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone by then
            return


atexit.register(release)
