"""Session helpers: one place for the settings and for cutting lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "gradeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; values already set by the cluster win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where none is set a temporary folder serves a session of one
    machine (tests); on a cluster it is an error, since no other machine could read it."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not set_dir and not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(set_dir or tempfile.mkdtemp(prefix="gradeloom-ckpt-"))
    return set_dir or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later stages survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` in the checkpoint folder; the folder ``path`` that it was read from is removed."""
    out = cut(df)
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # type: ignore[attr-defined]
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="gradeloom-"), "gradeloom.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, dirs, files in os.walk(root):
                dirs[:] = sorted(d for d in dirs if d != "__pycache__")
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    return spark
