"""Reliable lineage cuts: data goes to the shared checkpoint folder, never to executor disks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from textweave.session import new_folder, shared_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The same through compressed columns, for wide rows that are read more than once."""
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
