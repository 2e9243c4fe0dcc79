"""Token ids in binary shards, with a minimal perfect hash index from document key to place.

Shard file: `QTS1`, id width (u32), number of ids (u64), then the ids, little
endian. Shards hold documents in ascending doc_id order.

Index file, one per bucket of keys: `QMP1`, then counts, then the bit levels of
a minimal perfect hash (each key sets one bit in the first level where it meets
no other key; its number is the rank of that bit), then by number: fingerprint
(u32), shard (u32), length (u32), offset (u64). A lookup reads a bounded number
of bits and one entry; the fingerprint tells keys that are not in the index.

Files are written under a temporary name and renamed, so an attempt that dies
leaves nothing that is read, and an attempt that runs again writes the same.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_folder, released, stored, whole_text
from .encoding import encoder
from .packing import vocabulary_path

END_ID = 2
KEYS_PER_BUCKET = 100_000
GAMMA = 2.0
LEVELS = 48
READ_BYTES = 8_000_000
_SHARD, _INDEX = b"QTS1", b"QMP1"


# ---- files -------------------------------------------------------------------


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Out:
    """A file that appears under its name only when complete."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _fs(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = f"{root}/{name}"
        self.temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.temporary)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def commit(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.final)


def _read(folder: str, name: str):
    fs, root = _fs(folder)
    return fs.open_input_file(f"{root}/{name}")


# ---- minimal perfect hash ----------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, is_null: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    base = mix(ids.astype(np.int64).view(np.uint64))
    other = ordinal.astype(np.uint64) + np.uint64(1 << 40) * is_null.astype(np.uint64)
    return np.where(other > 0, mix(base + mix(other)), base)


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (mix(keys ^ seed) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1, one to one."""

    def __init__(self, levels: list[np.ndarray], left: np.ndarray):
        self.levels, self.left = levels, left  # left: sorted keys that no level took
        self.ranks = [np.cumsum(bits, dtype=np.int64) for bits in levels]
        self.bases = np.concatenate([[0], np.cumsum([r[-1] if len(r) else 0 for r in self.ranks])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < LEVELS:
            size = max(64, int(np.ceil(GAMMA * len(keys) / 64)) * 64)
            slots = _slot(keys, len(levels), size)
            bits = np.bincount(slots, minlength=size) == 1
            levels.append(bits)
            keys = keys[~bits[slots]]
        return cls(levels, np.unique(keys))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; for a key that was not built in, some number or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                break
            slots = _slot(keys[todo], level, len(bits))
            hit = bits[slots]
            out[todo[hit]] = self.bases[level] + self.ranks[level][slots[hit]] - 1
            todo = todo[~hit]
        if len(todo) and len(self.left):
            at = np.minimum(np.searchsorted(self.left, keys[todo]), len(self.left) - 1)
            same = self.left[at] == keys[todo]
            out[todo[same]] = self.bases[-1] + at[same]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype("<u4")


def _write_index(folder: str, name: str, keys: np.ndarray, shard, offset, length) -> None:
    mph = PerfectHash.build(keys)
    at = mph.find(keys)
    n = len(keys)
    table = {"f": np.zeros(n, "<u4"), "s": np.zeros(n, "<u4"), "l": np.zeros(n, "<u4"), "o": np.zeros(n, "<u8")}
    for k, v in (("f", _fingerprint(keys)), ("s", shard), ("l", length), ("o", offset)):
        table[k][at] = v
    out = _Out(folder, name)
    out.write(_INDEX + struct.pack("<QII", n, len(mph.levels), len(mph.left)))
    out.write(np.array([len(b) for b in mph.levels], "<u8").tobytes())
    for bits in mph.levels:
        out.write(np.packbits(bits).tobytes())
    out.write(mph.left.astype("<u8").tobytes())
    for k in "fslo":
        out.write(table[k].tobytes())
    out.commit()


class Index:
    """One bucket's index file."""

    def __init__(self, folder: str, name: str):
        with _read(folder, name) as f:
            raw = f.read()
        if raw[:4] != _INDEX:
            raise ValueError(f"{name} is not an index file")
        n, n_levels, n_left = struct.unpack_from("<QII", raw, 4)
        at = 20
        sizes = np.frombuffer(raw, "<u8", n_levels, at)
        at += 8 * n_levels
        levels = []
        for size in sizes.tolist():
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, size // 8, at)).astype(bool))
            at += size // 8
        self.mph = PerfectHash(levels, np.frombuffer(raw, "<u8", n_left, at))
        at += 8 * n_left
        self.table = {}
        for k, dtype in (("f", "<u4"), ("s", "<u4"), ("l", "<u4"), ("o", "<u8")):
            self.table[k] = np.frombuffer(raw, dtype, n, at)
            at += n * np.dtype(dtype).itemsize

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """found, shard, offset, length by key; a key outside the index is not found."""
        at = self.mph.find(keys)
        there = at >= 0
        safe = np.where(there, at, 0)
        if not len(self.table["f"]):
            return there, safe, safe, safe
        there &= self.table["f"][safe] == _fingerprint(keys)
        return there, self.table["s"][safe], self.table["o"][safe], self.table["l"][safe]


# ---- writing -----------------------------------------------------------------

ENTRIES = "id long, is_null boolean, ordinal long, shard int, offset long, n_tokens long"


def _write_shards(folder: str, path: str, end_id: int, width: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc = encoder(path, "word", width)
        end = np.array([end_id], enc.dtype).tobytes()
        out, at, last, ordinal, body = None, 0, None, 0, None
        for batch in arrow:
            ids, nulls = (batch.column(i).to_pylist() for i in range(2))
            if not ids:
                continue
            if out is None:
                out = _Out(folder, f"body-{shard:08d}")
            rows = []
            found, ends = enc.encode_column(batch.column(2))
            for doc_id, is_null, a, b in zip(ids, nulls, ends[:-1].tolist(), ends[1:].tolist()):
                ordinal = ordinal + 1 if last == (doc_id, is_null) else 0
                last = (doc_id, is_null)
                n = b - a + 1
                out.write(found[a:b].tobytes())
                out.write(end)
                rows.append((doc_id, is_null, ordinal, shard, at, n))
                at += n
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            names = ["id", "is_null", "ordinal", "shard", "offset", "n_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        if out is not None:
            out.write(_SHARD + struct.pack("<IQ", width, at))
            out.commit()

    return run


def _build_index(folder: str):
    def run(key, pdf):
        keys = key_hash(pdf["id"].to_numpy(), pdf["is_null"].to_numpy(), pdf["ordinal"].to_numpy())
        _write_index(folder, f"index-{key[0]:08d}", keys, pdf["shard"].to_numpy(), pdf["offset"].to_numpy(), pdf["n_tokens"].to_numpy())
        return pd.DataFrame({"bucket": [key[0]], "n_keys": [len(pdf)]})

    return run


def _bucket(n: int):
    return F.pmod(F.xxhash64("id", "is_null", "ordinal"), F.lit(n)).cast("int").alias("bucket")


class TokenStore:
    """Shards and index in one folder, and how many index buckets there are."""

    def __init__(self, folder: str, entries: DataFrame, buckets: int, width: int):
        self.folder, self.entries, self.buckets, self.width = folder, entries, buckets, width

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Places of keys (id, is_null, ordinal) by the index: adds shard, offset, n_tokens. Keys outside are left out."""
        folder = self.folder

        def run(key, pdf):
            hashes = key_hash(pdf["id"].to_numpy(), pdf["is_null"].to_numpy(), pdf["ordinal"].to_numpy())
            found, shard, offset, length = Index(folder, f"index-{key[0]:08d}").lookup(hashes)
            out = pdf[["id", "is_null", "ordinal"]].assign(shard=shard.astype("int32"), offset=offset.astype("int64"), n_tokens=length.astype("int64"))
            return out[found]

        asked = keys.select("id", "is_null", "ordinal", _bucket(self.buckets))
        return asked.groupBy("bucket").applyInPandas(run, ENTRIES)

    def payloads(self, places: DataFrame) -> DataFrame:
        """Reads the ids at places back from the shards: adds ids_crc32 (over 32-bit ids)."""
        folder, width = self.folder, self.width

        def run(key, pdf):
            pdf = pdf.sort_values("offset")
            sums, dtype = [], np.dtype(f"<u{width}")
            with _read(folder, f"body-{key[0]:08d}") as f:
                size = f.size()
                f.seek(size - 16)
                tail = f.read(16)
                if tail[:4] != _SHARD or struct.unpack("<IQ", tail[4:]) != (width, (size - 16) // width):
                    raise ValueError(f"shard {key[0]} is not complete")
                first, block = 0, b""
                for offset, n in zip(pdf["offset"].tolist(), pdf["n_tokens"].tolist()):
                    a, b = offset * width, (offset + n) * width
                    if a < first or b > first + len(block):
                        f.seek(a)
                        first, block = a, f.read(min(size - 16 - a, max(READ_BYTES, b - a)))
                    ids = np.frombuffer(block, dtype, n, a - first)
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            return pdf.assign(ids_crc32=np.array(sums, np.int64))

        return places.groupBy("shard").applyInPandas(run, ENTRIES + ", ids_crc32 long")

    def shard_starts(self) -> DataFrame:
        """ids of all shards before each; a row per shard."""
        sizes = self.entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def write_store(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = END_ID, width: int = 2) -> TokenStore:
    """Encodes all docs (null text: empty) into shards in ascending doc_id order and indexes them.

    A document's key is its doc_id and, among rows with the same doc_id, its
    place in the order of texts (repeated rows keep entries of their own); a
    null doc_id is a key like others and comes first. Other columns are not
    looked at. An empty table gives no shards and an index without buckets.
    Ids are stored in `width` bytes, which must hold the vocabulary.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    read = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("is_null"), whole_text().alias("text"))
    order = [F.desc("is_null"), F.col("id")]
    ranged = read.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    entries = stored(ranged.mapInArrow(released(_write_shards(folder, vocabulary, end_id, width), "encoding"), ENTRIES), "entries")
    buckets = max(1, -(-entries.count() // KEYS_PER_BUCKET))
    built = entries.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(_build_index(folder), "bucket int, n_keys long")
    built.write.format("noop").mode("overwrite").save()
    return TokenStore(folder, entries, buckets, width)


def read_back(store: TokenStore) -> DataFrame:
    """Every document's ids, found by key through the index and read from the shards."""
    rows = store.payloads(store.lookup(store.entries.select("id", "is_null", "ordinal")))
    return rows.join(store.shard_starts(), "shard").select(
        F.when(~F.col("is_null"), F.col("id")).alias("doc_id"), (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write_store(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json")))
