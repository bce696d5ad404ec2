"""Session settings and the shared folder that survives lost executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even when that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "textweave", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the library's settings; ``master`` is left to the cluster when None."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the library's runtime settings on a session someone else created."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, a laptop) a local folder is made and registered.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if configured:
        if known is None:
            context.setCheckpointDir(configured)
        return configured
    if known is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="textweave-"))
        known = context.getCheckpointDir()
    return known


def new_folder(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder; nothing is ever overwritten or removed there."""
    return os.path.join(shared_dir(spark).rstrip("/"), "textweave", f"{label}-{uuid.uuid4().hex}")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, as --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_textweave_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="textweave-"), "textweave"), "zip", root, "textweave"))
    context._textweave_shipped = True
