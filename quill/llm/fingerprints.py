"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in column expressions only.

A text is cut into paragraphs (lines, and runs of PARAGRAPH_WORDS words of a
long line), each hashed to a 64-bit key: 40 bits of digest and a 24-bit check
of them. A sketch has three tables of cells; each key is added to one cell of
each. Sketches of two versions subtract cell by cell, here by exclusive or, so
what both have falls out. A cell with one key left shows it: the check bits are
right, and the key belongs to the cell. Taking it out of its other cells peels
the rest. What is recovered are the paragraphs that only one version has, hence
the likeness: shared over all paragraphs.

A fingerprint is such a sketch, of one size for all texts. Two of them are
subtracted and peeled. Where more differs than they can tell, larger sketches
follow: keys are dealt to blocks by their upper bits, as many as both texts
need, each block with a sketch of its own, so work grows with the texts and not
with their square; a block that does not peel is sketched again, larger. The
sketch of both versions' keys together is the difference of their two sketches.

Everything about a document happens in its row. Texts are shuffled once, to
meet the next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, whole_text

PARAGRAPH_WORDS = 16
PARAGRAPH = rf"(?:[^ \n]++ *+){{1,{PARAGRAPH_WORDS}}}\n*+| ++\n*+|\n++"
TABLES = 3
#: Cells per table in the fingerprint, and in a block at the first and later attempts.
PRINTED_CELLS = 8
CELLS = (8, 16)
KEYS_PER_BLOCK = 8
ROUNDS = 10
CHECK_BITS = 24
SLOT_BITS = 5
MOST_BLOCK_BITS = 64 - CHECK_BITS - TABLES * SLOT_BITS


def with_value(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit((1 << CHECK_BITS) - 1))


def keys(text: Column) -> Column:
    """The distinct keys of a text's paragraphs."""

    def key(p):
        digest = F.shiftrightunsigned(F.xxhash64(p), CHECK_BITS)
        return with_value(digest, lambda d: F.shiftleft(d, CHECK_BITS).bitwiseOR(_check(d)))

    return F.array_distinct(F.transform(paragraphs(text), key))


def _mask(key: Column, cells: int) -> Column:
    """A bit for each of the key's cells, counted over all tables."""
    out = None
    for table in range(TABLES):
        slot = F.shiftrightunsigned(key, CHECK_BITS + SLOT_BITS * table).bitwiseAND(F.lit(cells - 1)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1 << (cells * table)).cast("long"), slot)
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def _bits(cells: int) -> Column:
    return F.array(*(F.lit(1 << i).cast("long") for i in range(TABLES * cells)))


def _masked(keys_: Column, cells: int) -> Column:
    return F.transform(keys_, lambda k: F.struct(k.alias("k"), _mask(k, cells).alias("m")))


def _added(cell: Column, bit: Column, masked: Column) -> Column:
    """The cell, with those of the keys that belong to it added or, what is the same, taken out."""
    return F.aggregate(masked, cell, lambda a, x: F.when(x.m.bitwiseAND(bit) != 0, a.bitwiseXOR(x.k)).otherwise(a))


def sketch(keys_: Column, cells: int) -> Column:
    """The cells of an array of keys; a key that is there twice falls out, so two versions' keys give their difference."""
    return with_value(_masked(keys_, cells), lambda masked: F.transform(_bits(cells), lambda bit: _added(F.lit(0).cast("long"), bit, masked)))


def peel(cells_: Column, cells: int) -> Column:
    """(c, k): the cells that are left, and the keys that were recovered."""

    def is_pure(v, i):
        good = _check(F.shiftrightunsigned(v, CHECK_BITS)) == v.bitwiseAND(F.lit((1 << CHECK_BITS) - 1))
        return (v != 0) & good & (_mask(v, cells).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)

    def take_out(state, pure):
        left = F.zip_with(state.c, _bits(cells), lambda v, bit: _added(v, bit, pure))
        return F.struct(left.alias("c"), F.concat(state.k, F.transform(pure, lambda x: x.k)).alias("k"), (F.size(pure) > 0).alias("on"))

    def one_round(state, _):
        found = lambda st: _masked(F.array_distinct(F.filter(st.c, is_pure)), cells)
        return F.when(~state.on, state).otherwise(with_value(found(state), lambda pure: take_out(state, pure)))

    start = F.struct(cells_.alias("c"), F.array().cast("array<bigint>").alias("k"), F.lit(True).alias("on"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)


def _block_difference(run: Column) -> Column:
    """The keys of one block that only one version has: ever larger sketches until one peels off whole."""

    def attempt(level: int) -> Column:
        if level == len(CELLS):
            # Keys that share all their cells: compare the sorted keys themselves.
            return F.filter(run, lambda k, i: F.coalesce(F.get(run, i - 1) != k, F.lit(True)) & F.coalesce(F.get(run, i + 1) != k, F.lit(True)))
        done = peel(sketch(run, CELLS[level]), CELLS[level])
        return with_value(done, lambda st: F.when(F.exists(st.c, lambda v: v != 0), attempt(level + 1)).otherwise(st.k))

    return attempt(0)


def with_difference(df: DataFrame, first: str, second: str, out: str) -> DataFrame:
    """Adds `out` and `out`_keys: the likeness of two versions, and the keys that only one has.

    first and second: structs of keys k and fingerprint cells c. The likeness is
    shared over all keys; 1 if both have none.
    """
    a, b = F.col(first), F.col(second)
    both = F.size(a["k"]) + F.size(b["k"])
    cells = F.zip_with(a["c"], b["c"], lambda x, y: x.bitwiseXOR(y))
    peeled = with_value(peel(cells, PRINTED_CELLS), lambda st: F.when(~F.exists(st.c, lambda v: v != 0), st.k))
    df = df.withColumn("_p", peeled)
    bits = F.least(F.lit(MOST_BLOCK_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(both, F.lit(1)) / KEYS_PER_BLOCK)).cast("int")))
    # What the fingerprints told is not sketched again.
    todo = F.when(F.col("_p").isNull(), F.sort_array(F.concat(a["k"], b["k"]))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_bits", bits).withColumn("_s", todo)
    # A shift by 64 is a shift by 0, so one block needs a rule of its own.
    block = lambda k: F.when(F.col("_bits") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", k, 64 - F.col("_bits")))
    df = df.withColumn("_b", F.transform("_s", block))
    heads = F.filter(F.transform("_b", lambda x, i: F.when((i == 0) | (x != F.get("_b", i - 1)), i + 1)), lambda i: i.isNotNull())
    df = df.withColumn("_heads", heads)
    runs = F.transform("_heads", lambda h, j: F.slice("_s", h, F.coalesce(F.get("_heads", j + 1), F.size("_s") + 1) - h))
    df = df.withColumn("_d", F.coalesce("_p", F.flatten(F.transform(runs, _block_difference))))
    apart = F.size("_d")
    shared = (both - apart) / 2
    df = df.withColumn(out, F.when(both == 0, F.lit(1.0)).otherwise(shared / (shared + apart)))
    return df.withColumn(f"{out}_keys", F.col("_d")).drop("_p", "_bits", "_s", "_b", "_heads", "_d")


def printed(version: str) -> Column:
    """The fingerprint of a version (k, c): number of paragraphs and the cells, in hexadecimal."""
    v = F.col(version)
    return F.concat(F.hex(F.size(v["k"]).cast("long")), F.lit(":"), F.array_join(F.transform(v["c"], lambda x: F.hex(x)), "-"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next row by (doc_id, hash of the row); after the last comes the first.

    Rows are dealt to ranges of that order. Each range also gets a copy of the
    first row behind it, so a window over one range sees every successor.
    """
    spark = docs.sparkSession
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("h"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    first = F.min(F.struct("doc_id", "h")).alias("b")
    # A row per range, so no more than partitions: the driver may hold them.
    ids = rows.select("doc_id", "h").repartitionByRange(ranges, *order)
    bounds = sorted((r["b"] for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(first).collect()), key=lambda b: (b.doc_id is not None, b.doc_id or 0, b.h))
    if not bounds:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    ids_of = F.split(F.lit(",".join(str(b.doc_id if b.doc_id is not None else -(1 << 63)) for b in bounds)), ",").cast("array<bigint>")
    has_id = F.split(F.lit(",".join(str(b.doc_id is not None) for b in bounds)), ",").cast("array<boolean>")
    hashes = F.split(F.lit(",".join(str(b.h) for b in bounds)), ",").cast("array<bigint>")
    own = F.coalesce("doc_id", F.lit(-(1 << 63)))

    def halve(state, step):
        middle = state + step
        at, at_h = F.get(ids_of, middle), F.get(hashes, middle)
        return F.when((middle < len(bounds)) & ((own > at) | ((own == at) & (F.col("h") >= at_h))), middle).otherwise(state)

    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    placed = rows.withColumn("p", F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)).withColumn("copy", F.lit(False))
    # Made of the same literals: rows from a Python list would start Python workers in the executors, which stay there.
    i = F.col("id").cast("int")
    head = (F.when(F.get(has_id, i), F.get(ids_of, i)).alias("b_id"), F.get(hashes, i).alias("b_h"), F.pmod(i - 1, F.lit(len(bounds))).alias("before"))
    heads = spark.range(0, len(bounds), 1, 1).select(*head)
    copies = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("h") == F.col("b_h"))).dropDuplicates(["before"])
    copies = copies.select("doc_id", "text", "h", F.col("before").alias("p"), F.lit(True).alias("copy"))
    behind = Window.partitionBy("p").orderBy("copy", *order)
    return placed.unionByName(copies).withColumn("next_text", F.lead("text").over(behind)).filter("not copy").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its fingerprint, its edited text's, their likenesses, and the digests of the paragraphs in which text and edited text differ.

    A null text is empty; empty texts have no paragraphs and are alike (1.0).
    Rows with the same doc_id follow each other by a hash of the row; a null
    doc_id comes first. A single document is its own next. An empty table gives
    no rows. Other columns are not looked at.
    """
    rows = with_next(docs)
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - tail), F.substr("next_text", F.lit(1), tail))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    texts = {"own": "text", "changed": "edited", "following": "next_text"}
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(keys(F.col(t)).alias(f"_{v}") for v, t in texts.items()))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", *(F.struct(F.col(f"_{v}").alias("k"), sketch(F.col(f"_{v}"), PRINTED_CELLS).alias("c")).alias(v) for v in texts))
    rows = with_difference(with_difference(rows, "own", "changed", "near_edited"), "own", "following", "near_next")
    digests = F.array_join(F.transform(F.sort_array("near_edited_keys"), lambda k: F.hex(F.shiftrightunsigned(k, CHECK_BITS))), ",")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", printed("own").alias("fingerprint"), printed("changed").alias("edited_fingerprint"), "near_edited", "near_next", digests.alias("edited_digests")
    )


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


#: The likeness by its definition, without any sketch; fingerprints as sketches of the same keys need xxhash64, so the query has no SQL.
ORACLE_SQL = None
