"""Session settings. Operators never build a session themselves."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_STAGES: list[str] = []
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship_package() -> None:
    """Let Python workers of this machine import the package; on a cluster it is installed or passed by --py-files."""
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "strideframe") -> SparkSession:
    """Local session for tests and benchmarks; a cluster supplies its own."""
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    ship_package()
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's own setting, else (tests on one machine only) one under /tmp."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strideframe-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write a stage table into the shared checkpoint folder and read it back.

    Ends the lineage where a result is read several times or was costly (a model fit, a filtered
    signal).  Parquet keeps column pruning and survives lost executors.  `clear_stages` removes the
    tables of a run.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> int:
    """Delete the stage tables written by this driver so far; call it when their results have been saved."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), len(_STAGES)
    while _STAGES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
