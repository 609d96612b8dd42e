"""Session defaults and lineage cutting shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "caseflow", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume.

    Shuffle partition counts are left to AQE (coalescing from the initial
    number, splitting skewed join partitions); a cluster sets its own initial
    number through ``spark.sql.shuffle.partitions``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared(df: DataFrame) -> str:
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return shared.rstrip("/")


def held(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared storage and read from there: compressed, and read by column."""
    path = f"{_shared(df)}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_lines(df: DataFrame) -> str:
    """Folder in the shared storage that ``df``, one text column, was written to; whoever reads it may delete it afterwards."""
    path = f"{_shared(df)}/lines-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a folder in the warehouse is used, which driver and executors share as well.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        conf = df.sparkSession.conf
        sc.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or f"{conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint(eager=True)
