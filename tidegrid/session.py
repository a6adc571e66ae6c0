"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. Shuffle partition count is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Sparse grids shrink to a few bytes a row when they are shuffled; tasks of the usual 64 MB would hold tens of millions of rows.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Inferring constraints from dozens of derived columns takes minutes of planning time.
    "spark.sql.constraintPropagation.enabled": "false",
    # The JVM never compiles methods above 8,000 bytes of bytecode; longer generated code would be
    # interpreted, so Spark should split it by expression instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Adaptive execution only joins partitions: from few of them, a task's share and the memory of its sorts would be large.
# Up to this number a shuffle is also written without sorting the rows before.
FIRST_PARTITIONS = 200


_LOCAL: dict[str, str] = {}  # the temporary folder of a local master
_MADE: list[str] = []  # paths below the shared folder that this process has handed out


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    first = max(FIRST_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(first))
    return spark


def local_session(cores: int = 8, app: str = "tidegrid", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the cluster.

    Only a local master may fall back to a temporary folder of this machine, because
    there driver and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get("folder")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    _LOCAL["folder"] = tempfile.mkdtemp(prefix="tidegrid-")
    return _LOCAL["folder"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch tables made inside the block when it ends.

    Results that read them have to be written or collected inside. Other paths are never touched.
    """
    start = len(_MADE)
    try:
        yield
    finally:
        discard(spark, _MADE[start:])


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch tables that nothing reads any more; only paths that this process has handed out."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        if path in _MADE:
            where = hadoop.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _MADE.remove(path)


def materialize(df: DataFrame, name: str = "stage", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of any executor. The copy stays until the enclosing
    ``scratch_scope`` ends, or for good without one. ``path`` is one of ``scratch_path``, to ``discard`` the copy earlier.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
