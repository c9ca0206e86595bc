"""Session settings, shared scratch storage and shipping of this package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ARROW_BYTES = "4194304"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the operators assume (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("minewright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where the setting is absent and the master is local (as in tests) is
    a temporary folder made; on a cluster executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark, "_minewright_scratch", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="minewright-")
            spark._minewright_scratch = root
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back.

    Cuts the lineage with files that survive the loss of any executor, and
    unlike checkpoint() keeps columns prunable. The shuffle files of the write
    go with it; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._minewright_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_minewright_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on executors and bound the Arrow batches."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != _ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _ARROW_BYTES)
    if getattr(context, "_minewright_shipped", False):
        return
    here = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="minewright-src-")) / "minewright_bundle.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent).as_posix())
    context.addPyFile(str(bundle))
    context._minewright_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
