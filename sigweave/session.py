"""Session with the settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "sigweave", master: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Hit lists are many small groups. Sorted, they are built one at a time;
        # hashed, they overflow the object map and are serialised row by row.
        .config("spark.sql.execution.useObjectHashAggregateExec", "false")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("SIGWEAVE_DRIVER_MEMORY", "8g"))
        builder = builder.config("spark.sql.shuffle.partitions", "8")
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local
    session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder so that a lost executor does
    not replay earlier rounds."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back. What reads it starts from files
    whose size the optimizer knows, so it broadcasts the table only if it is small."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed a few tasks a core while a file source is opened in here. By default
    Spark runs up to 10,000, a folder each, which costs more than what they list."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, 4 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out over the cores.

    A table in one small file would be read, and everything after it computed, by
    one task. Inputs with at least as many splits as cores, which is to say all
    large ones, are returned as they are and never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    context = spark.sparkContext
    target = Path("/tmp") / f"sigweave-{context.applicationId}.zip"
    if target.exists():
        return
    with zipfile.ZipFile(target, "w") as bundle:
        for file in sorted(root.rglob("*")):
            if file.suffix in (".py", ".json"):
                bundle.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
