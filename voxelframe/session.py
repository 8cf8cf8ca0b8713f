"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "voxelframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; ``conf`` keys use __ for dots."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.master(master) if master else b
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application, so that
    Python functions of it can be loaded wherever it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_voxelframe_shipped", None) != sc.applicationId:
        top = Path(__file__).resolve().parent
        fd, path = tempfile.mkstemp(prefix="voxelframe-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(path)
        sc._voxelframe_shipped = sc.applicationId
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it
    is unset and Spark runs on one machine, a temporary folder; elsewhere an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="voxelframe-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df):
    """``df`` by checkpoint(): its lineage ends in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
