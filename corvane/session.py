"""Session settings and the cutting of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corvane")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
    return sc.getCheckpointDir()


def leave_no_trace(spark: SparkSession, path: str) -> None:
    """``path`` goes when the driver's JVM ends, however that comes about short of a kill."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut`` writes inside go when this ends: for operations whose results are written elsewhere by then."""
    written: list[str] = []
    _scratch.append(written)
    try:
        yield
    finally:
        _scratch.pop()
        for path in written:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later jobs neither repeat
    its work nor depend on executors that may be lost. The table goes with the session, or with the ``scratch`` it is written in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/corvane-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    else:
        leave_no_trace(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a scan up to which it is dealt out anew; a larger one has splits enough of its own.
SPREAD = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A scan no larger than SPREAD, dealt out to all cores unless it has several partitions for each; any other as it is.
    So small input, such as a file of few row groups, of which many splits are empty, doesn't leave a costly step to one task, and
    large input isn't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not hasattr(df, "_jdf"):  # no classic DataFrame
        return df
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or int(str(plan.optimizedPlan().stats().sizeInBytes())) > SPREAD:
        return df
    held = plan.toRdd().getNumPartitions()
    return df.repartition(cores) if 0 < held < 4 * cores else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> SparkSession:
    """Give the workers this package where their PYTHONPATH doesn't already hold it."""
    package = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_corvane", False):
        return spark
    at = Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(at))
    sc._corvane = True
    return spark
