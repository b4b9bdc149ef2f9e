"""Session helpers: how tables are found, how lineage is cut, how many groups a job gets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "tesserae") -> SparkSession:
    """A session for tests and single-node runs. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset,
    as in tests, a folder of this machine is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesserae-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """As ``cut``, in compressed columns, for wide tables read several times by some of their columns; removed when the session ends."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, most: int) -> list | None:
    """The rows of ``df`` when there are at most ``most`` of them, else None.

    Reads at most ``most + 1`` rows, so a frame that turns out large never reaches
    the driver; callers keep a shuffled plan for that case.
    """
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None
