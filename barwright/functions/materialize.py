"""Materialise a table that several branches of a plan consume.

Without it Spark recomputes the whole lineage (down to the raw scan) once per
branch.  ``checkpoint`` writes to the shared ``spark.checkpoint.dir`` (reliable,
survives executor loss, cuts lineage); ``persist`` keeps it in executor
memory/disk and recomputes lost blocks from lineage.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def materialize(df: DataFrame, mode: str = "checkpoint") -> DataFrame:
    if mode == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if mode == "none":
        return df
    raise ValueError(f"unknown mode {mode!r}")
