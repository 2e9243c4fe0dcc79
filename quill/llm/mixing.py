"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas.

Each source's documents, in hashed order, form a stream of words that is gone
through up to three times. The part of the stream up to the source's target is
cut into blocks; a document belongs to the block where it starts. The numbers
of blocks per source are split down a binary tree: a node gives its left half a
draw from the multivariate hypergeometric law, the right half the rest, so the
quotas of the output shards add up exactly. Each source's blocks, permuted,
are dealt out to the shards by those quotas, and a shard orders its documents
by a hash.

All steps are DataFrame expressions. Texts are read once, for their sizes;
after that a row is a few numbers. A source may hold any share of the rows:
streams are summed in buckets of hashed order, never over a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored, whole_text, words

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 4096
BLOCKS_PER_SHARD = 256
DOCS_PER_BUCKET = 500
#: Rows that a running sum takes in one go, in each of its two levels.
ROWS_PER_RUN = 1000
SEED = 17
#: Rows of the table of sources up to which it is broadcast.
BROADCAST_SOURCES = 50_000
#: Rounds of swaps that permute the blocks of a source.
SWAP_ROUNDS = 32


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash of the whole row that orders the stream."""
    text = whole_text()
    return docs.select(
        F.col("doc_id"), F.col("source"), F.size(words(text)).cast("long").alias("size"), F.xxhash64(F.lit(SEED), "doc_id", "source", text).alias("h")
    )


def targets(sized: DataFrame) -> DataFrame:
    """Per source: rank, weight, source_size, target. Shares by weight; what exceeds three times a source's size is shared out again."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name))
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1))
    # From the source that reaches its limit first: what is left when those before it have theirs.
    by_limit = Window.orderBy(MOST_REPEATS * F.col("source_size") / F.col("weight"), "rank")
    before, rest = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - MOST_REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    table = table.withColumn("level", left / F.sum("weight").over(rest))
    free = MOST_REPEATS * F.col("source_size") > F.col("level") * F.col("weight")
    table = table.withColumn("level", F.min(F.when(free, F.struct(MOST_REPEATS * F.col("source_size") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    limit = (MOST_REPEATS * F.col("source_size")).cast("double")
    target = F.when(F.col("level").isNull(), limit).otherwise(F.least(limit, F.col("level") * F.col("weight")))
    return table.select("source", "rank", "weight", "source_size", target.alias("target"), F.least(F.round(target).cast("long"), MOST_REPEATS * F.col("source_size")).alias("quota"))


def running(table: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """table with the sum of `value` over the rows of the same key that come before, by a whole-number `order` unique in its key.

    Summed in two levels: inside runs of ROWS_PER_RUN numbers, then over the runs. No window holds a whole key's rows.
    """
    run = F.floor(F.col(order) / ROWS_PER_RUN).cast("long")
    inside = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = table.groupBy(key, run.alias("_run")).agg(F.sum(value).alias("_n")).select(key, "_run", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    local = table.withColumn("_run", run).withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(runs, [key, "_run"]).withColumn(name, F.col("_base") + F.col("_in")).drop("_run", "_in", "_base")


def _uniform(*what):
    return F.pmod(F.xxhash64(F.lit(SEED), *what), F.lit(1 << 52)) / float(1 << 52)


def hypergeometric(population, marked, drawn, u):
    """How many of `drawn` out of `population` are among the `marked`, for a uniform u: inverse transform around the mode."""
    n, k, d = (x.cast("double") for x in (population, marked, drawn))
    low, high = F.greatest(F.lit(0.0), d - (n - k)), F.least(k, d)
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2)).cast("double")))
    reach = F.ceil(8 * F.sqrt(F.greatest(F.lit(0.0), d * (k / F.greatest(n, F.lit(1.0))) * (1 - k / F.greatest(n, F.lit(1.0)))))) + 10
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)

    # Probabilities relative to the mode's, from there outwards.
    def step_up(x):
        return (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))

    def state(p, total, x):
        return F.struct(p.alias("p"), total.alias("total"), x.alias("x"))

    zero, one = F.lit(0.0), F.lit(1.0)

    def walk(xs, ratio, start_total, goal):
        """Adds probabilities along xs; x stays at the first place where the total passes the goal."""
        return F.aggregate(
            xs, state(one, start_total, F.lit(-1.0)), lambda a, x: state(a.p * ratio(x), a.total + a.p * ratio(x), F.when((a.x < 0) & (a.total + a.p * ratio(x) > goal), x).otherwise(a.x))
        )

    # Empty ranges would run backwards.
    ups = F.when(last > mode, F.sequence((mode + 1).cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    downs = F.when(first < mode, F.sequence((mode - 1).cast("long"), first.cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    up_ratio, down_ratio = lambda x: step_up(x - 1), lambda x: 1 / step_up(x)
    never = F.lit(float("inf"))
    below = walk(downs, down_ratio, zero, never)
    above = walk(ups, up_ratio, zero, never)
    goal = u * (below["total"] + one + above["total"])
    # The mode comes first, then the values above it, then those below: any fixed order serves.
    in_above = walk(ups, up_ratio, one, goal)
    in_below = walk(downs, down_ratio, one + above["total"], goal)
    drawn_x = F.when(goal < one, mode).when(in_above["x"] >= 0, in_above["x"]).when(in_below["x"] >= 0, in_below["x"]).otherwise(mode)
    return drawn_x.cast("long")


def split(node_quotas: str, left_total: str, node: str):
    """The left child's quotas: draws source by source, each out of what is left."""
    total = F.aggregate(node_quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(total.alias("population"), F.col(left_total).alias("to_draw"), F.array().cast("array<bigint>").alias("taken"))

    def one(a, q):
        x = hypergeometric(a.population, q, a.to_draw, _uniform(F.col(node), F.size(a.taken)))
        return F.transform(F.array(x), lambda v: F.struct((a.population - q).alias("population"), (a.to_draw - v).alias("to_draw"), F.concat(a.taken, F.array(v)).alias("taken")))[0]

    return F.aggregate(node_quotas, start, one)["taken"]


def shard_quotas(table: DataFrame, block_words: int, blocks_per_shard: int) -> DataFrame:
    """Row per (rank, block number in dealt order): which shard draws it."""
    spark = table.sparkSession
    blocks = F.ceil(F.col("quota") / block_words).cast("long")
    root = table.agg(F.array_sort(F.collect_list(F.struct("rank", blocks.alias("n")))).alias("q")).select(F.transform("q", lambda x: x.n).alias("quotas"))
    root = stored(root, "quotas")
    total = root.select(F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)).first()[0] or 0
    depth = max(0, (max(1, -(-total // blocks_per_shard)) - 1).bit_length())
    nodes = root.select(F.lit(1).cast("long").alias("node"), "quotas")
    for level in range(depth):
        size = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        halves = nodes.withColumn("left_total", F.floor(size / 2).cast("long")).withColumn("left", split("quotas", "left_total", "node"))
        both = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("quotas")),
            F.struct((2 * F.col("node") + 1).alias("node"), F.zip_with("quotas", "left", lambda a, b: a - b).alias("quotas")),
        )
        nodes = stored(halves.select(F.explode(both).alias("n")).select("n.node", "n.quotas"), "quotas").repartition(min(1 << level, 64))
    leaves = nodes.select((F.col("node") - (1 << depth)).alias("shard"), F.posexplode("quotas").alias("at", "n")).withColumn("rank", F.col("at") + 1)
    spans = running(leaves, "rank", "shard", "n", "first").filter("n > 0")
    return spans.select("rank", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("dealt"))


def permuted(x: Column, n: Column, seed: Column) -> Column:
    """A permutation of 0..n-1, row by row: in each round x and its mirror about a hashed point swap places, or not, by a hash of both."""

    def one(at: Column, turn: Column) -> Column:
        mirrored = lambda v: F.pmod(F.xxhash64(F.lit(SEED), seed, turn) % n - v, n)
        swap = F.xxhash64(F.lit(SEED + 2), seed, turn, F.greatest(at, mirrored(at))).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirrored(at)).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SWAP_ROUNDS)), x.cast("long"), one)


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, blocks_per_shard: int = BLOCKS_PER_SHARD) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: a row for every row of docs, with doc_id, source, size, h, rank,
    source_size, target, quota and `at`, its place in its source's stream.
    pieces: a row per document and turn that the mix takes, with rank, at,
    turn, taken (words; only a source's last piece is less than its document),
    shard and position in the shard.

    A null text and an empty one have size 0 and are never taken; a null source
    is a source of its own, the last; sources without words have target 0.
    Repeated rows are documents of their own. An empty table gives no rows.
    """
    sized = stored(sizes(docs), "sizes")
    table = stored(targets(sized), "targets")
    buckets = max(1, sized.count() // DOCS_PER_BUCKET)
    small = F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table
    joined = sized.alias("d").join(small.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rows = joined.select("doc_id", "d.source", "size", "h", "rank", "source_size", "target", "quota").withColumn("bucket", F.pmod("h", F.lit(buckets)))
    inside = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(rows.groupBy("rank", "bucket").agg(F.sum("size").alias("n")), "buckets")
    bases = running(sums, "rank", "bucket", "n", "base").drop("n")
    placed = rows.withColumn("in_bucket", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["rank", "bucket"])
    placed = stored(placed.withColumn("at", F.col("base") + F.col("in_bucket")).drop("base", "in_bucket", "bucket"), "placed")

    turns = placed.select("rank", "at", "size", "quota", "doc_id", "h", F.col("source_size"), F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1))).alias("turn"))
    start = F.col("turn") * F.col("source_size") + F.col("at")
    pieces = turns.withColumn("start", start).withColumn("taken", F.greatest(F.lit(0), F.least("size", F.col("quota") - F.col("start")))).filter("taken > 0")
    n = F.ceil(F.col("quota") / block_words).cast("long")
    block = F.floor(F.col("start") / block_words).cast("long")
    pieces = pieces.withColumn("dealt", permuted(block, n, F.col("rank"))).join(shard_quotas(table, block_words, blocks_per_shard), ["rank", "dealt"])
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED + 1), "rank", "at", "turn"), "rank", "at", "turn")
    return placed, pieces.select("doc_id", "h", "rank", "at", "turn", "taken", "shard", F.row_number().over(shuffled).alias("position"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """The documents of mix(), each with the words taken of it, its pieces by turn, and the shard and position of the first."""
    placed, pieces = mix(docs, **options)
    piece = F.struct("turn", F.col("taken").alias("words"), "shard", "position")
    sums = pieces.groupBy("rank", "at").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    # Documents without words share a place with the one behind them, and are not taken.
    own = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
    out = placed.join(sums, ["rank", "at"], "left").withColumn("taken", own).withColumn("pieces", F.when(F.col("size") > 0, F.col("pieces")))
    return out.withColumn("shard", F.get("pieces", F.lit(0))["shard"]).withColumn("position", F.get("pieces", F.lit(0))["position"])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself, with the columns of docs: a row for each turn a document is taken.

    Rows of a shard are in one partition, in the order of their positions.
    A piece that is less than its document has that many of its words, one blank apart.
    """
    names = docs.columns
    chosen = taken(docs, **options).filter("taken > 0").groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("pieces")).alias("_takes"))
    text = whole_text()
    keyed = docs.withColumn("_h", F.xxhash64(F.lit(SEED), "doc_id", "source", text)).withColumn("_id", F.col("doc_id"))
    chosen = chosen.select(F.col("doc_id").alias("_cid"), F.col("h").alias("_ch"), "_takes")
    both = keyed.join(chosen, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_h") == F.col("_ch")))
    same = Window.partitionBy("_id", "_h").orderBy(F.lit(1))
    both = both.withColumn("_mine", F.get("_takes", F.row_number().over(same) - 1)).filter("_mine is not null")
    both = both.withColumn("_size", F.size(words(text)).cast("long"))
    both = both.withColumn("_at", F.explode("_mine")).withColumn("_piece", F.col("_at.words"))
    part = F.array_join(F.slice(words(text), F.lit(1), F.col("_piece").cast("int")), " ")
    both = both.withColumn("text", F.when(F.col("_piece") < F.col("_size"), part).otherwise(F.col("text")))
    if "n_chars" in names:
        both = both.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    dealt = both.withColumn("_shard", F.col("_at.shard")).withColumn("_position", F.col("_at.position"))
    return dealt.repartition("_shard").sortWithinPartitions("_shard", "_position").select(*names)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "turns", "shard", "position")
