"""What several operators share: the shared folder, word splitting, text hygiene."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared

#: White space of the word rule `[^\x20\x09-\x0D]+`.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_GAP_CHARS = " \t\n\x0b\x0c\r"


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared.folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "table") -> DataFrame:
    """df, computed once and written to the shared folder; its lineage ends there.

    An executor that is lost takes nothing with it: later stages read the files.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(text: str = "text") -> Column:
    """The text, with null taken as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; empty without any."""
    inner = F.btrim(text, F.lit(WORD_GAP_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A key of more rows than this, and than a BROADCAST_KEYS-th of all rows, has its row of a table broadcast: BROADCAST_KEYS rows at most.
HOT_ROWS = 2000
BROADCAST_KEYS = 50_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined ("left" or "inner") with a table that has each key once, and in _n how many of the rows have it.

    The keys of very many rows are joined by broadcast, so no key's rows pile
    up in one task; by their definition they are few. _n is left out.
    """
    most, total = table.agg(F.max("_n"), F.sum("_n")).first()
    bound = max(HOT_ROWS, (total or 0) // BROADCAST_KEYS)
    if (most or 0) <= bound:
        return rows.join(table.drop("_n"), key, how)
    hot = table.filter(F.col("_n") > bound).drop("_n").withColumn("_hot", F.lit(True))
    met = rows.join(F.broadcast(hot), key, "left")
    rest = met.filter("_hot is null").select(*rows.columns).join(table.filter(F.col("_n") <= bound).drop("_n"), key, how)
    return met.filter("_hot").drop("_hot").unionByName(rest)


# ---- memory of Python workers --------------------------------------------------


def give_back(collect: bool = True) -> None:
    """Free memory of this process goes back to the system, where the C library can do that."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):
        pass  # another C library; it keeps what it likes


#: What tasks of an operator keep for its next ones in the same worker.
_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """The place for what an operator's tasks keep in a worker, for as long as no other operator's tasks run there."""
    return _KEPT.setdefault(operator, {})


def only_kept(operator: str | None) -> None:
    """Frees what other operators' tasks have kept in this worker."""
    others = [things for name, things in _KEPT.items() if name != operator and things]
    for things in others:
        things.clear()
    if others:
        give_back()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None):
    """run, a function for mapInArrow, that gives memory back when its task ends; keeps: the operator whose kept() it uses.

    Workers wait for the next task beside the JVM, and wait with all that the
    allocators kept of the task before; the stages that follow need that room.
    So they do what other operators keep: models and tokenizers go first.
    """

    def task(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_kept(keeps)
        try:
            yield from run(arrow)
        finally:
            give_back()

    return task
