"""Suffix-array dedup: bytes of LENGTH-byte strings that start at two places or more are removed.

A repeated string must be found wherever its copies are, so the corpus is cut
by content: every run of LENGTH bytes holds an anchor, the ANCHOR-byte string
of least hash in it, and copies hold the same anchor at the same place. Only
anchors that occur twice matter. The runs about an anchor are dealt to a few
ranges by where the anchor stands in them. All runs of a range lie in a span
and hold a core. Where two places have the same span, all runs of the range
repeat; places without the same core have no run in common.

What is left, equal cores in different spans, is compared by the method: the
Burrows-Wheeler transform of the spans is built, and intervals of suffixes are
extended backwards, breadth first. Each level finds the common prefixes of one
length, by increasing length, and the expansion stops at LENGTH; what no level
has separated by then shares LENGTH bytes.

Texts are shuffled twice, by a hash of the text: to cut out spans that must be
compared, and to cut out what repeats. Anchors are some numbers each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, released, stored, whole_text

LENGTH = 200
ANCHOR = 32
#: Bytes of surroundings that one transform holds, unless one anchor has more.
BLOCK_BYTES = 1_500_000
END = 0xFF  # no byte of UTF-8
#: Ranges of distances from a run's start to its anchor.
RANGES = 3
#: Distances in a range of the second round, among spans that share a core.
NARROW = 13
#: Spans whose parts are hashed at a time.
HASHED_ROWS = 4000
#: Stands for a whole core; no byte of UTF-8 either.
CORE = b"\xfe"
#: Bytes that the first sort of suffixes looks at, and so the length that expansion starts from.
FIRST = 8

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of `width` values."""
    done = 1
    while 2 * done <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def gram_hashes(data: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """A hash of each run of `size` bytes, `size` a power of two."""
    h, done = _BYTE[data], 1
    while done < size:
        h = mix(h[:-done] * np.uint64(_BASE) + h[done:])
        done *= 2
    return h


def anchors(data: np.ndarray, length: int = LENGTH, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): every run of `length` bytes has one of the places in it, chosen by what the run holds alone."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, width = gram_hashes(data, size), length - size + 1
    least = _slide(h, width, np.minimum)
    # A place is an anchor if its hash is the least of some run that it is in.
    edge = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at]


class Hashes:
    """Hashes of any substring of data."""

    def __init__(self, data: np.ndarray):
        self.inverse = _powers(_BASE_INVERSE, len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_BASE, len(data))[:-1], dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))


# ---- Burrows-Wheeler transform -----------------------------------------------


def first_bytes(data: np.ndarray) -> np.ndarray:
    """The first FIRST bytes from each place, as one number."""
    wide = np.concatenate([data, np.full(FIRST, END, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(data), np.uint64)
    for k in range(FIRST):
        key = (key << np.uint64(8)) | wide[k : len(data) + k]
    return key


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes or more; data ends with as many END."""
    n, key = len(data), first_bytes(data)
    order = np.argsort(key, kind="stable")
    done = FIRST
    while True:
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if done >= depth or new.all():
            return order
        far = np.concatenate([rank[done:], np.full(min(done, n), -1)]) + 1
        key = (rank * np.int64(n + 1) + far).astype(np.uint64)
        # Suffixes that stand alone stay where they are; only ties are sorted again.
        alone = new & np.concatenate([new[1:], [True]])
        tied = np.flatnonzero(~alone)
        order[tied] = order[tied][np.argsort(key[order[tied]], kind="stable")]
        done *= 2


def separated(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): starts[i] says that suffix order[i] and the one before share less than `length` bytes.

    Backward extension over intervals of the transform: the interval of a string
    w gives, for each byte c before its suffixes, the interval of cw. All strings
    of one length are extended before the next; an interval that ends where no
    shorter one did shows a common prefix of just that length. The intervals of
    the first FIRST bytes are read off the sorted suffixes.
    """
    n = len(data)
    order = suffix_order(data, length + 56)
    before = data[order - 1]  # the transform; for the first suffix the last byte, an END
    by_byte = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)
    step[by_byte] = np.arange(n)
    key = first_bytes(data)[order]
    starts = np.ones(n + 1, bool)
    starts[1:n] = key[1:] != key[:-1]
    low = np.flatnonzero(starts[:n])
    high = np.flatnonzero(starts[1:])
    for _ in range(FIRST, length):
        wide = high > low
        single = step[low[~wide]]
        lo, hi = low[wide], high[wide]
        sizes = hi - lo + 1
        which = np.repeat(np.arange(len(lo)), sizes)
        at = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[which]
        key = which * 256 + before[at]
        by_key = np.argsort(key, kind="stable")
        key, at = key[by_key], at[by_key]
        if len(key):
            first = np.concatenate([[True], key[1:] != key[:-1]])
            last = np.concatenate([first[1:], [True]])
            low, high = np.concatenate([single, step[at[first]]]), np.concatenate([single, step[at[last]]])
        else:
            low = high = single
        fresh = ~starts[high + 1]
        low, high = low[fresh], high[fresh]
        starts[high + 1] = True
        if not len(low):
            break
    return order, starts[:n]


def repeated_windows(contexts: list[bytes], groups: np.ndarray, lefts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context the places, from its start, of `length`-byte strings that another context of its group has at the same distance from the anchor."""
    parts = np.array([len(c) for c in contexts], np.int64)
    first = np.cumsum(parts + 1) - (parts + 1)
    data = np.frombuffer(b"\xff".join(contexts) + b"\xff" * (length + 64), np.uint8)
    order, starts = separated(data, length)
    kind = np.empty(len(data), np.int64)
    kind[order] = np.cumsum(starts)
    runs = np.maximum(parts - length + 1, 0)
    which = np.repeat(np.arange(len(contexts)), runs)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
    place = kind[first[which] + offset]
    distance = offset - lefts[which] + 4 * length
    # Same string, same anchor, same distance: sorted together, neighbours tell.
    by = np.lexsort((distance, groups[which], place))
    same = (place[by][1:] == place[by][:-1]) & (groups[which][by][1:] == groups[which][by][:-1]) & (distance[by][1:] == distance[by][:-1])
    twice = np.zeros(len(which), bool)
    twice[by[1:]] |= same
    twice[by[:-1]] |= same
    cuts = np.cumsum(runs)[:-1]
    return [o[t] for o, t in zip(np.split(offset, cuts), np.split(twice, cuts))]


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, nth): for each count its number as often, and 0, 1, 2 up to it."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def repeated_starts(spans: list[bytes], groups: np.ndarray, lefts: np.ndarray, length: int = LENGTH, width: int = NARROW) -> list[np.ndarray]:
    """As repeated_windows(), after a second round of spans and cores over narrow ranges, which leaves little to compare."""
    sizes = np.array([len(x) for x in spans], np.int64)
    # All ranges are of one width, if need be by overlap of the last two.
    low = np.minimum(np.arange(0, length - ANCHOR + 1, width), length - ANCHOR + 1 - width)
    high = low + width - 1
    parts = []
    for at in range(0, len(spans), HASHED_ROWS):
        size, left, group = sizes[at : at + HASHED_ROWS], lefts[at : at + HASHED_ROWS], groups[at : at + HASHED_ROWS]
        a, b = np.maximum(0, left[:, None] - high), np.minimum(size[:, None], left[:, None] - low + length)
        x, y = left[:, None] - low, left[:, None] - high + length
        row, k = np.nonzero((b - a >= length) & (x >= 0) & (y <= size[:, None]) & (y > x))
        a, b, x, y = a[row, k], b[row, k], x[row, k], y[row, k]
        begin = (np.cumsum(size) - size)[row]
        sums = Hashes(np.frombuffer(b"".join(spans[at : at + HASHED_ROWS]), np.uint8))
        where = mix(group.astype(np.int64).view(np.uint64)[row] + mix(k.astype(np.uint64)))
        core = mix(where + sums.of(begin + x, begin + y))
        span = mix(where + mix(sums.of(begin + a, begin + b) + (left[row] - a).astype(np.uint64) * _M2))
        parts.append((row + at, *(v.astype(np.int32) for v in (a, b, x, y)), core, span))
    row, a, b, x, y, core, span = (np.concatenate(v) for v in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 7
    _, one, same, count = np.unique(span, return_index=True, return_inverse=True, return_counts=True)
    full = count[same] > 1
    _, near = np.unique(core, return_inverse=True)
    open_ = (np.bincount(near[one], minlength=len(near))[near] > 1) & (np.bincount(near, ~full, len(near))[near] > 0)
    asked = one[open_[one]]
    pick, nth = _runs(np.where(full, b - a - length + 1, 0))
    rows, starts = [row[pick]], [a[pick] + nth]
    # Group by group, a bounded number of bytes at a time.
    asked = asked[np.argsort(near[asked], kind="stable")]
    weight = np.cumsum((b - a)[asked] - (y - x)[asked] + 2)
    ends = np.flatnonzero(np.diff(near[asked])) + 1
    cuts, last = [0], 0
    for e in ends.tolist():
        if weight[e - 1] - last > BLOCK_BYTES // 4:
            cuts.append(e)
            last = weight[e - 1]
    for i, j in zip(cuts, [*cuts[1:], len(asked)]):
        own = asked[i:j]
        if not len(own):
            continue
        # A core that all of a group share counts as one byte, so runs of `length` become runs of `width`.
        places = (v[own].tolist() for v in (row, a, x, y, b))
        cut = [spans[r][p:q] + CORE + spans[r][m:n] for r, p, q, m, n in zip(*places)]
        for u, found in zip(own.tolist(), repeated_windows(cut, near[own], lefts[row[own]] - a[own], width)):
            if not full[u] and len(found):
                rows.append(np.full(len(found), row[u]))
                starts.append(a[u] + found)
    rows, starts = np.concatenate(rows), np.concatenate(starts)
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    edges = np.searchsorted(rows, np.arange(len(spans) + 1))
    return [np.unique(starts[i:j]) for i, j in zip(edges, edges[1:])]


def merged(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by strings of `length` bytes at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + length).tolist()))


# ---- Spark -------------------------------------------------------------------


def ranges_of(length: int) -> list[tuple[int, int]]:
    """(least, greatest) distance of each range: a run that starts that far before the anchor belongs to it."""
    edges = [round(i * (length - ANCHOR + 1) / RANGES) for i in range(RANGES + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def _find_anchors(length: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            nodes, texts = batch.column("node").to_numpy(), batch.column("text").to_pylist()
            at, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < 2_000_000 and i + 1 < len(texts):
                    continue
                raw = [t.encode("utf-8", "surrogatepass") for t in texts[at : i + 1]]
                own = nodes[at : i + 1]
                at, size = i + 1, 0
                lengths = np.array([len(r) for r in raw], np.int64)
                ends = np.cumsum(lengths)
                data = np.frombuffer(b"".join(raw), np.uint8)
                places, hashes = anchors(data, length)
                doc = np.searchsorted(ends, places, "right")
                # Runs over two texts choose anchors as well; those inside a text that is long enough do no harm.
                inside = (places + ANCHOR <= ends[doc]) & (lengths[doc] >= length) if len(places) else np.zeros(0, bool)
                places, hashes, doc = places[inside], hashes[inside], doc[inside]
                begin = ends - lengths
                sums = Hashes(data)
                first, last = begin[doc], ends[doc]
                columns = [hashes.view(np.int64), own[doc], (places - first).astype(np.int32), lengths[doc].astype(np.int32)]
                names = ["h", "node", "place", "n_bytes"]
                for k, (low, high) in enumerate(ranges_of(length)):
                    a, b = np.maximum(first, places - high), np.minimum(last, places - low + length)
                    # In all runs of the range; without it there is none.
                    x, y = places - low, places - high + length
                    none = (x < first) | (y > last) | (b - a < length)
                    core = sums.of(np.where(none, 0, x), np.where(none, 0, y))
                    span = mix(sums.of(np.where(none, 0, a), np.where(none, 0, b)) + (places - a).astype(np.uint64) * _M2)
                    columns += [pa.array((core >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=none), span.view(np.int64)]
                    names += [f"core{k}", f"span{k}"]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    return run


def _cut_spans(length: int):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            out: list[tuple] = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(x["g"], x["span"], x["place"] - x["a"], raw[x["a"] : x["b"]]) for x in wanted]
                if len(out) > 20_000:
                    yield _span_batch(out)
                    out = []
            if out:
                yield _span_batch(out)

    return run


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["g", "span", "left", "bytes"])


def _compare(length: int):
    """(g, span, starts, ends): where each span holds strings that another of its group has too, counted from the anchor."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            lefts = np.array([r[2] for r in held], np.int64)
            found = repeated_starts([r[3] for r in held], np.array([r[0] for r in held], np.int64), lefts, length)
            rows = [(r[0], r[1], [a - r[2] for a, _ in m], [b - r[2] for _, b in m]) for r, o in zip(held, found) if (m := merged(o, length))]
            held.clear()
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["g", "span", "starts", "ends"])

        for batch in arrow:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and size > BLOCK_BYTES and held[-1][0] != row[0]:
                    yield done()
                    size = 0
                if held and held[-1][:2] == row[:2]:
                    continue  # copies of a text bring the same span
                held.append(row)
                size += len(row[3])
        if held:
            yield done()

    return run


def _remove(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow:
        lists = batch.column("ranges")
        offsets, struct = lists.offsets.to_numpy(), lists.values
        low, high = (struct.field(f).to_numpy(zero_copy_only=False) for f in ("a", "b"))
        none = lists.is_null().to_numpy(zero_copy_only=False)
        rows = []
        for i, (text, all_) in enumerate(zip(batch.column("text").to_pylist(), batch.column("whole").to_pylist())):
            raw = text.encode("utf-8", "surrogatepass")
            spans: list = [(0, len(raw))] if all_ else []
            if not all_ and not none[i]:
                spans = joined(low[offsets[i] : offsets[i + 1]], high[offsets[i] : offsets[i + 1]])
            at, parts = 0, []
            for a, b in spans:
                parts.append(raw[at:a])
                at = b
            kept = b"".join([*parts, raw[at:]]) if spans else raw
            rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, types)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def joined(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one, in order."""
    if not len(low):
        return []
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(low[1:] > reach[:-1]) + 1
    return list(zip(low[np.concatenate([[0], new])].tolist(), reach[np.concatenate([new - 1, [len(low) - 1]])].tolist()))


def repeated_ranges(read: DataFrame, length: int = LENGTH) -> DataFrame:
    """(node, ranges): the byte ranges of each text, named by its hash, that hold strings which start elsewhere too."""
    schema = "h long, node long, place int, n_bytes int" + "".join(f", core{k} int, span{k} long" for k in range(RANGES))
    found = read.select("node", "text").mapInArrow(released(_find_anchors(length)), schema)
    # Copies of a text are one node, so their anchors are the same places.
    place, anchor = F.struct("node", "place"), Window.partitionBy("h")
    found = found.withColumn("twice", F.min(place).over(anchor) != F.max(place).over(anchor)).filter("twice")
    bounds = ranges_of(length)
    each = F.array(*(F.struct(F.lit(k).alias("range"), F.col(f"core{k}").alias("core"), F.col(f"span{k}").alias("span"), F.lit(low).alias("low"), F.lit(high).alias("high")) for k, (low, high) in enumerate(bounds)))
    units = found.select("h", "node", "place", "n_bytes", F.explode(F.filter(each, lambda x: x.core.isNotNull())).alias("x")).select("h", "node", "place", "n_bytes", "x.*")
    units = units.withColumn("a", F.greatest(F.lit(0), F.col("place") - F.col("high"))).withColumn("b", F.least("n_bytes", F.col("place") - F.col("low") + length))
    # Still dealt by h: none of these windows moves a row.
    alike, near = Window.partitionBy("h", "range", "span"), Window.partitionBy("h", "range", "core")
    units = units.withColumn("first", F.min(place).over(alike)).withColumn("full", F.col("first") != F.max(place).over(alike))
    units = units.withColumn("open", (F.min("span").over(near) != F.max("span").over(near)) & ~F.min("full").over(near))
    units = units.filter("full or open").select(
        "node", "place", "a", "b", "full", "open", "span", F.xxhash64("h", "range", "core").alias("g"), (F.col("open") & (F.col("first") == place)).alias("is_first")
    )
    units = stored(units, "spans")

    wanted = units.filter("is_first").groupBy("node").agg(F.collect_list(F.struct("g", "span", "place", "a", "b")).alias("wanted"))
    cut = read.select("node", "text").join(wanted, "node").mapInArrow(released(_cut_spans(length)), "g long, span long, left int, bytes binary")
    compared = cut.repartition("g").sortWithinPartitions("g", "span").mapInArrow(released(_compare(length)), "g long, span long, starts array<int>, ends array<int>")

    whole = units.filter("full").select("node", "a", "b")
    part = units.filter("open and not full").join(compared, ["g", "span"]).select("node", "place", F.explode(F.arrays_zip("starts", "ends")).alias("x"))
    part = part.select("node", (F.col("place") + F.col("x.starts")).alias("a"), (F.col("place") + F.col("x.ends")).alias("b"))
    return whole.unionByName(part).groupBy("node").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Strings of `length` bytes that also start elsewhere, in the same text or in
    another row's, are removed wherever they stand. A null text is empty; a text
    shorter than `length` loses nothing. Repeated rows are texts of their own,
    so long enough ones are removed whole. An empty table gives no rows. Other
    columns are not looked at. Texts are told apart by a 64-bit hash.
    """
    text = whole_text()
    read = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("node"))
    copies = read.select("node").groupBy("node").count().filter("count > 1").select("node", F.lit(True).alias("copied"))
    ranges = repeated_ranges(read, length).join(copies, "node", "full")
    rows = read.join(ranges, "node", "left").withColumn("whole", F.coalesce("copied", F.lit(False)) & (F.octet_length("text") >= length))
    schema = docs.select("doc_id").schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    return rows.select("doc_id", "text", "ranges", "whole").mapInArrow(released(_remove), schema.add("kept_sha256", "string"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
