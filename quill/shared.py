"""The folder that driver and executors share."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; it becomes the checkpoint folder, too.

    Only a local master may leave it unset: there a temporary folder is shared
    by all. On a cluster each machine would write to its own disk, so that is refused.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = f"file://{tempfile.mkdtemp(prefix='quill-shared-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder as Parquet; its lineage ends there.

    What a lost executor held is read again. Unlike a checkpoint the table has
    its true size, so joins of later rounds are planned by it.
    """
    path = f"{folder(df.sparkSession).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle of both sides, for tables with a row a path or more.

    What is made of few columns of a compressed file, or exploded from it, looks
    small to the planner: it would be sent to the driver and every executor whole.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt out by keys to as many partitions as the session's shuffles have.

    Few bytes can be much work for what follows; the planner joins partitions by their bytes unless their number is given.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, first rows of its groups): what is dealt out and sorted by the first `keys` columns, some `least` rows and whole groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        held += [] if batch is None or not batch.num_rows else [batch]
        if not held or (batch is not None and sum(b.num_rows for b in held) < least):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        first = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in (k.to_numpy() for k in table.columns[:keys])])))
        # The last group may go on in the next batch.
        whole = len(table) if batch is None else int(first[-1])
        if whole:
            yield table.slice(0, whole), first[first < whole]
        held = table.slice(whole).to_batches()


def large(rows: DataFrame, keys: list[str], at_once: int) -> DataFrame | None:
    """The keys that more than at_once rows share, or None if there are none."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > at_once).select(*keys).transform(stored)
    return None if found.isEmpty() else found
