"""Session helpers: package shipping, the shared checkpoint folder, table loading."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomspan")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python stages pickle their functions by reference, so the workers must be
    able to import the package wherever they run.
    """
    context = spark.sparkContext
    name = f"loomspan-{context.applicationId}.zip"
    if any(str(f).endswith(name) for f in context._python_includes):
        return
    folder = tempfile.mkdtemp(prefix="loomspan-ship-")
    path = os.path.join(folder, name)
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, f"{_PACKAGE.name}/{file.relative_to(_PACKAGE)}")
    context.addPyFile(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A local session without that setting (tests, a laptop) gets a folder of its own; on a
    cluster executors couldn't read one, so a missing setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="loomspan-checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = shared_folder(df.sparkSession)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores, before work that takes longer than moving them, where the scan has so few parts that half the cores would idle.

    A large table has more parts than cores and isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
