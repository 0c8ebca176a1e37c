"""Sessions, driver tables and stage tables."""

from __future__ import annotations

import gc
import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that is given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cairnlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this folder import the package, wherever the driver was started.

    A cluster whose executors do not see the folder gets the package with --py-files.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([home, *paths])


#: Bytes of an Arrow batch that goes to a Python worker; Spark's own limit of 64 MB is held several times over.
ARROW_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to ARROW_BYTES, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if now and int(now[1]) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, with whatever columns its Parquet schema has."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset a local session, as in tests, takes a temporary folder; on a cluster, whose executors
    would each write to a folder of their own, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        jvm_dir = context._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cairnlake-")
        context.setCheckpointDir(found)
    return found


#: Folders that staged() wrote inside each kept_tables() block that is open.
_WRITTEN: list[list[str]] = []


@contextmanager
def kept_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Write with the function given, which is staged(); at the end the stage tables written inside by others are dropped."""
    kept: set[str] = set()
    _WRITTEN.append([])

    def keep(df: DataFrame) -> DataFrame:
        out = staged(df)
        kept.add(_WRITTEN[-1][-1])
        return out

    try:
        yield keep
    finally:
        written = _WRITTEN.pop()
        for folder in written:
            if folder not in kept:
                _drop(spark, folder)
        if _WRITTEN:
            _WRITTEN[-1] += [f for f in written if f in kept]


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getName().startswith("stage-"):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: the rows outlive lost executors, and later jobs do not compute them again.
    """
    spark = df.sparkSession
    importable(spark)
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], partition_by: str | None = None, version: int = 1, options: dict[str, str] | None = None) -> DataFrame:
    """A table derived from the files at `source`, written once in the shared folder and read by every later query.

    Its folder carries the source's path, bytes, files and time, so a changed source is derived anew, and the version of
    the rule that derives it, so a changed rule is too. options: the writer's.
    """
    importable(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(path)
    state = f"{source} {summary.getLength()} {summary.getFileCount()} {fs.getFileStatus(path).getModificationTime()} v{version}"
    out = f"{shared_dir(spark)}/derived-{name}-{hashlib.sha256(state.encode()).hexdigest()[:16]}"
    done = hadoop.Path(f"{out}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        writer = build().write.mode("overwrite").options(**options or {})
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(out)
    return spark.read.parquet(out)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged() frame that no pending plan reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _drop(df.sparkSession, folder)


def released(spark: SparkSession) -> None:
    """Let go of shuffles, broadcasts and plans that nothing holds any more, between the steps of a loop.

    Spark frees them when the driver collects its garbage, which a driver that only plans small jobs puts off until
    its heap is full.
    """
    gc.collect()  # Python's frames hold the plans
    spark.sparkContext._jvm.System.gc()
