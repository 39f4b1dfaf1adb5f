"""Session settings and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
CHECKPOINT_DIR = "spark.checkpoint.dir"
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Moments are UTC throughout."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session, whose executors share the machine, may fall back to a
    temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="kartei-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends here and survives lost executors."""
    spark = frame.sparkSession
    folder = new_folder(spark, name)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def write_compact(frame: DataFrame, folder: str) -> None:
    """Write the frame with little disk: packed tightly, and what was shuffled for it goes once it is written.

    Else shuffle files stay until the driver happens to collect its garbage.
    """
    conf = frame.sparkSession.conf
    before = conf.get(RELEASE, None)
    conf.set(RELEASE, "true")
    try:
        frame.write.option("compression", "zstd").option("parquet.writer.version", "v2").parquet(folder)
    finally:
        if before is None:
            conf.unset(RELEASE)
        else:
            conf.set(RELEASE, before)


def compact(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, like ``written``, with little disk."""
    folder = new_folder(frame.sparkSession, name)
    write_compact(frame, folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package wherever the driver was started from."""
    context = spark.sparkContext
    if any(Path(f).name == f"{PACKAGE.name}.zip" for f in context.listFiles):
        return
    folder = Path(tempfile.mkdtemp(prefix="kartei-package-"))
    bundle = folder / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(bundle, "w") as target:
        for source in sorted(PACKAGE.rglob("*.py")):
            target.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(bundle))
