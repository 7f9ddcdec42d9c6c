"""Session set-up shared by queries, tests and the command line."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

def session(name: str = "weftgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tested with; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"}
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable by Python workers."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one is set only where the session names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = os.path.join(ROOT, ".checkpoints")
        context.setCheckpointDir(named)
        current = named
    return current


def kept(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder as Parquet: smaller than a checkpoint, and read by column and filter."""
    path = f"{shared_folder(rows.sparkSession)}/kept-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    made = rows.sparkSession.read.schema(rows.schema).parquet(path)
    made.kept_in = path
    return made


def drop(rows: DataFrame) -> None:
    """The files of rows that were kept go; nothing may read them any more."""
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rows.kept_in)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows that agree in ``by`` together, in as many parts as shuffles have.

    What is grouped then takes the memory of one part, however few files the rows come from and however well they
    compress; Spark would group each file's rows first, and put parts together by their compressed size. A column that is
    one constant can't be in ``by``: Spark then would shuffle once more.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")
