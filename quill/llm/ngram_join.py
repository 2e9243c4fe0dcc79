"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are texts with different n-gram sets (equal sets are one
row, found by a digest); columns are hashed n-grams, ordered by their frequency
in the corpus, rare ones first.

1. Frequencies. Scan tasks deal their n-grams to column blocks by hash, as
   packed arrays; a block's task counts them and sends back to each batch of
   rows only the columns that a second row has. An n-gram that many rows of a
   batch have is sent once, with its count.
2. Prefixes. Two sets can reach the threshold only if they share one of their
   first |x| - ceil(t |x|) + 1 columns. Unique columns come first in the order,
   so most rows have no column left to share and are done.
3. Candidates. The rows of a column are paired where their sizes, and the
   columns that are left behind this one in both, allow the overlap that the
   two sizes ask for. Columns of up to LIST_ROWS rows are paired whole. Rows of
   longer ones meet a few pivots, so a thousand near copies cost a thousand
   products; only rows that are then outside the column's largest component
   meet the others, so no link is lost.
4. Products. A row is multiplied with blocks of its candidates: overlap counts
   are accumulated column block by column block, and a pair is dropped as soon
   as the columns left cannot bring it to the size-derived bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, looked_up, released, stored, whole_text
from .components import components
from .wordhash import digests, runs, shingle_sets

SHINGLE_WORDS = 5
PERCENT = 80
#: Rows of a column that are paired whole.
LIST_ROWS = 32
#: Rows that each row of a longer column meets in a round, and how many rounds there are before the rest is paired.
PIVOTS = 8
PIVOT_ROUNDS = 2
#: Bytes of text, and n-grams of a batch of rows, that a scan task holds at once (one text at least).
BATCH_BYTES = 4_000_000
#: N-grams of a column block, about.
BLOCK_GRAMS = 1_000_000
#: An n-gram of so many rows of a batch is sent as one count.
BATCH_HOT = 64
#: Candidates of a row that one task multiplies with it, about; columns of a step of the product.
ROW_BLOCK = 2000
COLUMN_BLOCK = 64
#: Rows of the list of left-out documents up to which it is broadcast.
BROADCAST_ROWS = 500_000
KEY_BITS = np.uint64((1 << 48) - 1)


# ---- rows --------------------------------------------------------------------


def _row_sets(size: int):
    """Adds n_shingles and node, the name of the row's set (null: none), in place of _text."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            texts = batch.column("_text")
            for first, end in runs(texts, BATCH_BYTES):
                grams, starts = shingle_sets(texts.slice(first, end - first), size)
                counts, nodes = np.diff(starts), digests(grams, starts)
                rest = batch.slice(first, end - first).drop_columns(["_text"])
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array(counts, pa.int64()), pa.array(nodes, pa.int64(), mask=counts == 0)], names=[*rest.schema.names, "n_shingles", "node"]
                )

    return run


# ---- column frequencies ------------------------------------------------------

#: block -1 - ...: a batch's manifest; else a batch's n-grams of a column block.
_SENT = "batch long, block long, a binary, b binary, c binary, d binary"


def _six(keys: np.ndarray) -> bytes:
    """The low 48 bits of each key."""
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def _sent_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["batch", "block", "a", "b", "c", "d"])


def _block_of(grams: np.ndarray, blocks: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def _send(size: int, blocks: int):
    """Each batch's n-grams by column block: a keys, b the rows they are of; c keys of many rows, d their counts.

    The manifest of a batch: a its nodes, b their sizes, c keys of many rows, d the rows, as (key, row).
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for whole in arrow:
            texts = whole.column(0)
            for first, end in runs(texts, BATCH_BYTES):
                grams, starts = shingle_sets(texts.slice(first, end - first), size)
                nodes, sizes = digests(grams, starts), np.diff(starts)
                # One row for each set of the batch.
                _, once = np.unique(nodes, return_index=True)
                once = once[sizes[once] > 0]
                once.sort()
                if not len(once):
                    continue
                chosen = np.zeros(len(nodes), bool)
                chosen[once] = True
                row = np.cumsum(chosen) - 1
                of = np.repeat(np.arange(len(nodes)), sizes)
                mine = chosen[of]
                grams, of = grams[mine], row[of[mine]]
                values, counts = np.unique(grams, return_counts=True) if len(once) > BATCH_HOT else (grams[:0], grams[:0])
                hot = values[counts >= BATCH_HOT]
                hot_counts = counts[counts >= BATCH_HOT].astype("<u4")
                is_hot = np.zeros(len(grams), bool)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
                    is_hot = hot[at] == grams
                pairs = np.stack([_ids(grams[is_hot], blocks), of[is_hot].astype(np.uint64)], 1) if len(hot) else np.zeros((0, 2), np.uint64)
                out = [(number, -1, nodes[once].astype("<i8").tobytes(), sizes[once].astype("<i8").tobytes(), pairs.astype("<u8").tobytes(), b"")]
                grams, of = grams[~is_hot], of[~is_hot]
                block, hot_block = _block_of(grams, blocks), _block_of(hot, blocks)
                order = np.argsort(block.astype(np.uint16) if blocks < 65536 else block, kind="stable")
                grams, of, block = grams[order], of[order].astype("<u2"), block[order]
                used = np.union1d(block, hot_block)
                cuts = np.searchsorted(block, used), np.searchsorted(block, used, "right")
                for b, lo, hi in zip(used.tolist(), cuts[0].tolist(), cuts[1].tolist()):
                    here = hot_block == b if len(hot) else np.zeros(0, bool)
                    out.append((number, b, _six(grams[lo:hi]), of[lo:hi].tobytes(), _six(hot[here]), hot_counts[here].tobytes()))
                number += 1
                yield _sent_rows(out)

    return run


def _ids(grams: np.ndarray, blocks: int) -> np.ndarray:
    """A column's name: 48 bits of the n-gram's hash and 16 of its block's number."""
    return (grams & KEY_BITS) | (_block_of(grams, blocks).astype(np.uint64) << np.uint64(48))


def _answer(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every block, to each batch: a the columns that two rows have, b the rows, c the frequencies; columns of many rows with row 65,535."""
    held: list[tuple] = []

    def counted() -> pa.RecordBatch | None:
        keys = [_from_six(r[2]) for r in held]
        hots = [_from_six(r[4]) for r in held]
        flat = np.concatenate([*keys, *hots])
        order = np.argsort(flat)
        ordered = flat[order]
        weights = np.concatenate([np.ones(sum(map(len, keys)), np.int64), *[np.frombuffer(r[5], "<u4").astype(np.int64) for r in held]])[order]
        head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(flat) else np.zeros(0, np.int64)
        total = np.add.reduceat(weights, head) if len(head) else weights
        frequency = np.empty(len(flat), np.int64)
        frequency[order] = np.repeat(total, np.diff(np.append(head, len(flat))))
        ids = flat | np.uint64((held[0][1] & 0xFFFF) << 48)
        rows, at, hot_at = [], 0, sum(map(len, keys))
        for (batch, block, _, of, *_), k, h in zip(held, keys, hots):
            mine, f = ids[at : at + len(k)], frequency[at : at + len(k)]
            row = np.frombuffer(of, "<u2")
            shared = f > 1
            hot_ids, hot_f = ids[hot_at : hot_at + len(h)], frequency[hot_at : hot_at + len(h)]
            at, hot_at = at + len(k), hot_at + len(h)
            if shared.any() or len(h):
                sent_ids = np.concatenate([mine[shared], hot_ids]).astype("<u8")
                sent_rows = np.concatenate([row[shared], np.full(len(h), 65535, "<u2")]).astype("<u2")
                sent_f = np.minimum(np.concatenate([f[shared], hot_f]), 0xFFFFFFFF).astype("<u4")
                rows.append((batch, block, sent_ids.tobytes(), sent_rows.tobytes(), sent_f.tobytes(), b""))
        held.clear()
        return _sent_rows(rows) if rows else None

    for batch in arrow:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[1] < 0:
                yield _sent_rows([row])
                continue
            if held and held[-1][1] != row[1] and (out := counted()):
                yield out
            held.append(row)
    if held and (out := counted()):
        yield out


ROWS = "node long, n long, prefix int, first int, grams array<long>"


def _ordered(percent: int):
    """Rows that have a shared column in their prefix: how many such, the place of the first, and all shared columns in order."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch | None:
            manifest = next(r for r in held if r[1] < 0)
            nodes, sizes = (np.frombuffer(manifest[k], "<i8") for k in (2, 3))
            answers = [r for r in held if r[1] >= 0]
            held.clear()
            if not answers:
                return None
            ids = np.concatenate([np.frombuffer(r[2], "<u8") for r in answers])
            rows = np.concatenate([np.frombuffer(r[3], "<u2") for r in answers]).astype(np.int64)
            freq = np.concatenate([np.frombuffer(r[4], "<u4") for r in answers])
            hot = rows == 65535
            pairs = np.frombuffer(manifest[4], "<u8").reshape(-1, 2)
            if len(pairs):
                by = np.argsort(ids[hot])
                known, known_f = ids[hot][by], freq[hot][by]
                ids = np.concatenate([ids[~hot], pairs[:, 0]])
                freq = np.concatenate([freq[~hot], known_f[np.searchsorted(known, pairs[:, 0])]])
                rows = np.concatenate([rows[~hot], pairs[:, 1].astype(np.int64)])
            order = np.lexsort((ids, freq, rows))
            ids, rows = ids[order], rows[order]
            shared = np.bincount(rows, minlength=len(nodes))
            prefix = sizes - (percent * sizes + 99) // 100 + 1 - (sizes - shared)
            kept = np.flatnonzero(prefix > 0)
            if not len(kept):
                return None
            wanted = (prefix > 0)[rows]
            offsets = np.concatenate([[0], np.cumsum(shared[kept])]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[wanted].view(np.int64)))
            columns = [pa.array(nodes[kept]), pa.array(sizes[kept]), pa.array(np.minimum(prefix, shared)[kept], pa.int32()), pa.array((sizes - shared)[kept], pa.int32()), grams]
            return pa.RecordBatch.from_arrays(columns, names=["node", "n", "prefix", "first", "grams"])

        for batch in arrow:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][0] != row[0] and (got := out()):
                    yield got
                held.append(row)
        if held and (got := out()):
            yield got

    return run


def incidence(texts: DataFrame, size: int, percent: int, n_grams: int, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """The rows of the incidence matrix that can have a link: ROWS, one per set. texts: _text."""
    blocks = max(1, -(-n_grams // block_grams))
    sent = texts.select("_text").mapInArrow(released(_send(size, blocks)), _SENT)
    # Manifests only pass through, dealt by their batch.
    dealt = sent.repartition("block", F.when(F.col("block") < 0, F.col("batch"))).sortWithinPartitions("block")
    answers = dealt.mapInArrow(released(_answer), _SENT)
    rows = answers.repartition("batch").sortWithinPartitions("batch").mapInArrow(released(_ordered(percent)), ROWS)
    rows = stored(rows, "rows")
    # A set that several batches hold: frequencies are the same for all, so any of its rows will do.
    again = rows.groupBy("node").count().filter("count > 1").select("node")
    if again.isEmpty():
        return rows
    return stored(rows.dropDuplicates(["node"]), "rows")


# ---- candidates --------------------------------------------------------------


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether two rows of a column can reach the bound: by size, and by what is left behind the column in both."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & ((F.lit(100 + percent) * left) >= F.lit(percent) * (n + m))


def _pairs_of(x: Column, y: Column) -> list[Column]:
    return [F.greatest(x, y).alias("u"), F.least(x, y).alias("v")]


def _whole(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of the rows of each short column."""
    lists = postings.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("node", "n", "at"))).alias("rows"))
    one = lists.select(F.posexplode("rows").alias("i", "x"), "rows")
    two = one.select("x", F.explode(F.slice("rows", F.col("i") + 2, F.size("rows"))).alias("y"))
    return two.filter(_possible("x", "y", percent)).select(*_pairs_of(F.col("x.node"), F.col("y.node"))).distinct()


def _meeting(rows: DataFrame, probes: DataFrame, percent: int) -> DataFrame:
    """Pairs of the probes of each long column with its rows of other labels. Both: gram, node, n, at, label; salts of the column."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    sent = probes.select("gram", F.struct("node", "n", "at").alias("y"), F.col("label").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    met = dealt.withColumn("x", F.struct("node", "n", "at")).join(sent, ["gram", "salt"]).filter(F.col("label") != F.col("other"))
    return met.filter(_possible("x", "y", percent)).select(*_pairs_of(F.col("x.node"), F.col("y.node"))).distinct()


# ---- products ----------------------------------------------------------------


def overlaps(left: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, size: int, percent: int, step: int = COLUMN_BLOCK) -> np.ndarray:
    """Overlap counts of one row with a block of rows, whose columns follow one another in flat; -1 where a pair was dropped.

    Columns are in one order in all rows. After each column block of the rows a
    pair is dropped whose count, with all columns that are left, stays below the bound.
    """
    n = np.diff(starts)
    bound = (percent * (size + sizes) + 99 + percent) // (100 + percent)
    counts, alive = np.zeros(len(n), np.int64), np.minimum(n, len(left)) >= bound
    table, at = np.sort(left), 0
    while (todo := np.flatnonzero(alive & (n > at))).size:
        width = np.minimum(n[todo] - at, step)
        places = np.arange(width.sum()) + np.repeat(starts[todo] + at - np.cumsum(width) + width, width)
        values = flat[places]
        found = table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values
        counts[todo] += np.bincount(np.repeat(np.arange(len(todo)), width), found, len(todo)).astype(np.int64)
        at += step
        alive[todo] = counts[todo] + np.maximum(n[todo] - at, 0) >= bound[todo]
    return np.where(alive & (counts >= bound), counts, -1)


def _products(percent: int):
    """Links of each left row (role 0, which comes first of its group) with the block of rows behind it."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, left_n = None, None, 0
        for batch in arrow:
            group = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            nodes, sizes = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            lists = batch.column(5)
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()
            change = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1
            us, vs = [], []
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(nodes)]):
                name = (int(group[lo, 0]), int(group[lo, 1]))
                if group[lo, 2] == 0:
                    key, left, left_n = name, flat[ends[lo] : ends[lo + 1]].copy(), int(sizes[lo])
                    continue
                if name != key:
                    raise AssertionError("a block of candidates without its row")
                got = overlaps(left, flat, ends[lo : hi + 1], sizes[lo:hi], left_n, percent)
                hit = np.flatnonzero(got >= 0)
                us.append(np.full(len(hit), name[0], np.int64))
                vs.append(nodes[lo:hi][hit])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are links. Of two rows the one in more pairs is sent once to each block of its candidates."""
    pairs = stored(pairs, "pairs")
    degrees = stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("_n")), "degrees")

    def of(end: str) -> DataFrame:
        return degrees.select(F.col("node").alias(end), F.col("_n").alias(f"n_{end}"), "_n")

    both = looked_up(looked_up(pairs, of("u"), "u"), of("v"), "v")
    u, v = F.struct(F.col("n_u").alias("n"), F.col("u").alias("node")), F.struct(F.col("n_v").alias("n"), F.col("v").alias("node"))
    blocks = lambda n: F.ceil(F.col(n) / ROW_BLOCK).cast("long")
    ends = both.select(F.greatest(u, v).alias("hub"), F.least(u, v).alias("leaf"))
    ends = ends.select(F.col("hub.node").alias("hub"), F.col("leaf.node").alias("node"), F.pmod(F.xxhash64("leaf.node"), blocks("hub.n")).alias("block"), F.pmod(F.xxhash64("hub.node"), blocks("leaf.n")).alias("copy"))
    ends = stored(ends, "ends")
    copies = degrees.select("node", F.explode(F.sequence(F.lit(0).cast("long"), blocks("_n") - 1)).alias("copy"))
    wide = copies.join(rows.select("node", "n", "grams"), "node")
    rights = ends.join(wide, ["node", "copy"]).select("hub", "block", F.lit(1).alias("role"), "node", "n", "grams")
    hubs = ends.select(F.col("hub").alias("node"), "block").distinct()
    lefts = hubs.join(rows, "node").select(F.col("node").alias("hub"), "block", F.lit(0).alias("role"), "node", "n", "grams")
    dealt = lefts.unionByName(rights).repartition("hub", "block").sortWithinPartitions("hub", "block", "role")
    return stored(dealt.mapInArrow(released(_products(percent)), "u long, v long"), "links")


def links(rows: DataFrame, percent: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """(u, label) of every row that is linked to another and is not its component's label."""
    exploded = rows.select("node", "n", "first", F.posexplode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("i", "gram"))
    postings = stored(exploded.select("gram", "node", "n", (F.col("first") + F.col("i")).cast("long").alias("at")), "postings")
    lengths = stored(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "lengths")
    short = looked_up(postings, lengths.filter(F.col("_n") <= list_rows), "gram", "inner")
    found = _verified(_whole(short, percent), rows, percent)
    long_lists = lengths.filter(F.col("_n") > list_rows)
    if long_lists.isEmpty():
        return components(found)
    salted = long_lists.withColumn("salts", F.ceil(F.col("_n") / ROW_BLOCK).cast("long"))
    left = stored(looked_up(postings, salted, "gram", "inner").select("gram", "node", "n", "at", "salts"), "long")
    # The more of the long columns a row has, the nearer it is to the middle of its copies.
    weights = stored(left.groupBy("node").agg(F.count(F.lit(1)).alias("_n")), "weights")
    for turn in range(PIVOT_ROUNDS + 1):
        labels = components(found)
        per_node = weights.join(labels, F.col("node") == F.col("u"), "left").select("node", "_n", F.col("_n").alias("weight"), F.coalesce("label", "node").alias("label"))
        named = looked_up(left, per_node, "node", "inner").select("gram", "node", "n", "at", "salts", "weight", "label")
        parts = named.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("size"))
        most = parts.groupBy("gram").agg(F.sum("size").alias("_n"), F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("size", "label")).alias("most"))
        most = stored(most.filter("labels > 1"), "most")
        if most.isEmpty():
            return labels
        open_rows = stored(looked_up(named, most, "gram", "inner"), "open")
        if turn < PIVOT_ROUNDS:
            # Other rows in every round, the best of each of PIVOTS hashed parts.
            mine = open_rows.filter(F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(PIVOT_ROUNDS)) == turn)
            best = mine.groupBy("gram", F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(PIVOTS))).agg(F.max(F.struct("weight", F.xxhash64(F.lit(3), "node"), "node", "n", "at", "label", "salts")).alias("pivot"))
            probes = best.select("gram", "pivot.node", "pivot.n", "pivot.at", "pivot.label", "pivot.salts")
        else:
            probes = open_rows.filter("label != most")
        found = found.unionByName(_verified(_meeting(open_rows, probes, percent), rows, percent))
    return components(found)


# ---- documents ---------------------------------------------------------------


def join(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, list_rows: int = LIST_ROWS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """One row per row of docs: doc_id, h (a hash of the row's id and text), n_shingles, label, component_id.

    Two documents link if the Jaccard similarity of their sets of word n-grams
    is percent / 100 or more; component_id is the smallest doc_id that links
    reach. Words are cut at ASCII white space after A-Z are lower-cased. A null
    or empty text, or one without words, has no n-grams and links with nothing;
    fewer words than n are one n-gram. Repeated rows link (unless empty); a
    null doc_id takes part and is never the smallest. An empty table gives no
    rows. Other columns are not looked at. Sets are told apart by 63 hashed
    bits, n-grams by 48 and those of their column block's number.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("_text"))
    hashed = read.withColumn("h", F.xxhash64("doc_id", "_text"))
    sets = stored(hashed.mapInArrow(released(_row_sets(size)), "doc_id long, h long, n_shingles long, node long"), "sets")
    n_grams = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    labels = links(incidence(read, size, percent, n_grams, block_grams), percent, list_rows)
    nodes = sets.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("least"))
    named = nodes.join(labels, F.col("node") == F.col("u"), "left").withColumn("label", F.coalesce("label", "node")).drop("u")
    least = named.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.min("least").alias("component"))
    named = stored(looked_up(named.withColumnRenamed("_n", "copies").drop("least"), least, "label", "inner").select("node", F.col("copies").alias("_n"), "label", "component"), "named")
    # A document without n-grams is alone.
    found = looked_up(sets, named, "node")
    return found.select("doc_id", "h", "n_shingles", "label", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id, of equals by a hash of the row.

    A null doc_id comes behind all others. Rows without n-grams are components
    of their own and stay, repeated ones too; of rows that are alike in id and
    text one stays. An empty table stays empty; other columns are kept.
    """
    joined = join(docs, **options)
    order = F.struct(F.col("doc_id").isNull().alias("_null"), F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    none = F.lit(-(1 << 63))
    keys = stored(joined.filter("label is not null").groupBy("label", F.coalesce("doc_id", none).alias("_kid"), F.col("h").alias("_kh")).agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("order")), "keys")
    best = keys.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.min("order").alias("best"))
    judged = looked_up(keys, best, "label", "inner").select("_kid", "_kh", (F.col("order") != F.col("best")).alias("_goes"), (F.col("copies") > 1).alias("_more"))
    # Only the rows that go, or stand for several, have to be found again.
    marked = stored(judged.filter("_goes or _more"), "marked")
    if marked.count() <= BROADCAST_ROWS:
        marked = F.broadcast(marked)
    keyed = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.coalesce(F.col("doc_id").cast("long"), none).alias("_kid"), F.xxhash64(F.col("doc_id").cast("long"), whole_text()).alias("_kh"))
    found = keyed.join(marked, ["_kid", "_kh"], "left").filter("_goes is null or not _goes")
    alone = found.filter("_goes is null").select("_row.*")
    more = found.filter("_goes is not null").groupBy("_kid", "_kh").agg(F.first("_row").alias("_row")).select("_row.*")
    return alone.unionByName(more)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """join() over all documents, by 4-word shingles and a similarity of 0.85; odd rows as stated there."""
    return join(documents(spark, sf_dir), size=4, percent=85).select("doc_id", "n_shingles", "component_id")
