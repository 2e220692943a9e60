"""Session helpers: the shared scratch folder and a small local session."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
_shipped_to: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without the setting; it then gets a temporary
    folder, because driver and executors are one process on one machine.
    """
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="kindred-")
    return _local_dir


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for a table or stream state."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(rows: DataFrame, name: str) -> DataFrame:
    """Rows as a table in the shared folder: computed once, read as often as needed.

    Staged tables are left behind; let the folder's own retention remove them.
    """
    spark, path = rows.sparkSession, work_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def unstage(table: DataFrame) -> None:
    """Remove a staged table that nothing reads any more: those of a search's rounds would fill the folder."""
    spark = table.sparkSession
    folders = {name.rsplit("/", 1)[0] for name in table.inputFiles()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no table needs any more: it does so when the driver's JVM
    collects what refers to them, which may otherwise be long after a large step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ensure_checkpointing(spark: SparkSession) -> None:
    """Give ``checkpoint()`` (and ml's iterative fits) the shared folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")


def union(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of both tables, columns matched by name.

    Spark 4.1 pairs the partitions of a union's inputs when their partitioning looks alike,
    and fails when adaptive execution then gives them different partition counts. A plain
    union needs no pairing, so the session's setting for it is turned off.
    """
    one.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return one.unionByName(other)


def parallelism(spark: SparkSession) -> int:
    """Tasks the cluster can usefully run at once."""
    return max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever they run; once per application.

    Not needed where the package is installed or given with ``--py-files``.
    """
    global _shipped_to
    sc = spark.sparkContext
    if _shipped_to == sc.applicationId:
        return
    package = Path(__file__).resolve().parent
    # Spark copies the file to its own store when it is added.
    target = Path(tempfile.mkdtemp(prefix="kindred-")) / "kindred.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped_to = sc.applicationId


def query_id(batch: DataFrame) -> str:
    """The id Spark keeps in a stream's checkpoint: batch numbers are unique only within it."""
    found = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not found:
        raise RuntimeError("not called by a streaming query")
    return found


def local_session(cores: str | int = "*", memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark."""
    n = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kindred")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
