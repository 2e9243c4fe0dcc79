"""Quality rules: counting rules and a hashed n-gram log-likelihood ratio, in column expressions only.

Two multinomials over hashed words and word pairs: one of trusted documents,
one of the raw corpus. A document's score is the mean, over its n-grams, of the
log ratio of the two. The weights are whole millionths, so sums do not depend
on the order of addition and every document falls on the same side of the
threshold in every run.

One pass counts (only bucket counts are shuffled), one pass scores; texts are
never shuffled. The trusted ids are the one thing broadcast, TRUSTED_DOCS at
most; the weights are one row of BUCKETS numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text, words

BUCKETS = 10_000
#: Labelled rows that the trusted multinomial is fitted on, at most (by md5 of their id).
TRUSTED_DOCS = 20_000
#: Mean log ratio, in millionths, from which a document is kept.
THRESHOLD = -100_000
#: Factor of the first word's hash in a pair's.
PAIR = 1_000_003
REPEAT = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30


def _with_hashes(docs: DataFrame) -> DataFrame:
    """Adds _h, the hashes of the words of _w, and _pairs, those of neighbours; their buckets are the remainders."""
    hashed = docs.withColumn("_h", F.transform("_w", lambda w: F.crc32(w.cast("binary"))))
    n = F.greatest(F.size("_h") - 1, F.lit(0))
    return hashed.withColumn("_pairs", F.zip_with(F.slice("_h", F.lit(1), n), F.slice("_h", F.lit(2), n), lambda a, b: a * PAIR + b))


def trusted_ids(labels: DataFrame, most: int = TRUSTED_DOCS) -> DataFrame:
    """ids of documents labelled good and not toxic: `most` at most, chosen by the md5 of the id."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    ids = good.select(F.col("doc_id").cast("long").alias("_trusted")).distinct()
    return ids.orderBy(F.md5(F.col("_trusted").cast("string").cast("binary")), "_trusted").limit(most)


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: `_weights`, the log ratio by bucket in millionths."""
    read = docs.select(F.col("doc_id").alias("_id"), words(whole_text()).alias("_w"))
    marked = read.join(F.broadcast(trusted), F.col("_id") == F.col("_trusted"), "left").withColumn("_good", F.col("_trusted").isNotNull())
    grams = _with_hashes(marked).select("_good", F.explode(F.concat("_h", "_pairs")).alias("_x")).select("_good", F.pmod("_x", F.lit(buckets)).alias("_b"))
    counts = grams.groupBy("_b").agg(F.count(F.lit(1)).alias("_raw"), F.count_if("_good").alias("_target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("_b"))
    table = every.join(counts, "_b", "left").agg(F.array_sort(F.collect_list(F.struct("_b", F.coalesce("_raw", F.lit(0)).alias("r"), F.coalesce("_target", F.lit(0)).alias("t")))).alias("_t"))
    total = table.select("_t", F.aggregate("_t", F.lit(0).cast("long"), lambda a, x: a + x.r).alias("_r"), F.aggregate("_t", F.lit(0).cast("long"), lambda a, x: a + x.t).alias("_n"))
    weight = F.transform("_t", lambda x: F.round(1e6 * (F.ln((x.t + 1.0) / (F.col("_n") + float(buckets))) - F.ln((x.r + 1.0) / (F.col("_r") + float(buckets))))).cast("long"))
    # Without trusted documents there is nothing to compare with: every weight is 0.
    return total.select(F.when(F.col("_n") > 0, weight).otherwise(F.array_repeat(F.lit(0).cast("long"), buckets)).alias("_weights"))


def repeated_words(docs: DataFrame, words_: str, out: str, size: int = REPEAT) -> DataFrame:
    """Adds `out`: the words that lie in a window of `size` words found twice or more in the text."""
    n = F.size(words_)
    windows = F.when(n > size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(words_, i, size)))).otherwise(F.array().cast("array<bigint>"))
    found = docs.withColumn("_win", windows)
    found = found.withColumn("_s", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(
        F.transform("_s", lambda x, k: F.when((F.get("_s", k - 1).h == x.h) | (F.get("_s", k + 1).h == x.h), x.i)),
        lambda i: i.isNotNull(),
    )
    found = found.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(twice)))
    gaps = F.zip_with("_p", F.slice("_p", 2, F.size("_p")), lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size)))
    covered = F.when(F.col("_p").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x))
    return found.withColumn(out, covered).drop("_win", "_s", "_p")


def quality(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Counting rules and the verdict for every document, one row each.

    A null text has no words; it and an empty text fail the base rules. Repeated
    rows are judged alike and all returned. Without trusted labels all scores
    are 0. An empty table gives no rows. Other columns are not looked at.
    """
    table = weights(docs, trusted_ids(labels), buckets)
    base = docs.select(F.col("doc_id"), whole_text().alias("_text")).withColumn("_w", words(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("_lines", lines).select(
        "doc_id",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    base = _with_hashes(repeated_words(base, "_w", "n_repeat_words")).drop("_w")
    # BUCKETS numbers, whatever the corpus holds; folded into one literal of the plan.
    by_bucket = F.split(F.lit(",".join(map(str, table.first()[0]))), ",").cast("array<bigint>")

    def total(hashes: str):
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a + F.get(by_bucket, F.pmod(x, F.lit(buckets)).cast("int")))

    scored = base.withColumn("_sum", total("_h") + total("_pairs")).withColumn("_n", (F.size("_h") + F.size("_pairs")).cast("long")).drop("_h", "_pairs")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return scored.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("_sum") >= threshold * F.col("_n"))).alias("kept"),
        F.when(F.col("_n") > 0, F.round(F.col("_sum") / F.col("_n"), 0).cast("long")).otherwise(F.lit(0).cast("long")).alias("score_millionths"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: CRC-32 by its definition, over the distinct words; the rest states the rules another way.
ORACLE_SQL = rf"""
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab
), d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), tok AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
), vocab AS (
  SELECT word, xor(list_reduce(list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::BIGINT),
         lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM (SELECT DISTINCT word FROM tok), tab
), hashed AS (
  SELECT doc_id, pos, h, lag(h) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM tok JOIN vocab USING (word)
), grams AS (
  SELECT doc_id, h % {BUCKETS} AS b FROM hashed
  UNION ALL SELECT doc_id, (before * {PAIR} + h) % {BUCKETS} FROM hashed WHERE before IS NOT NULL
), trusted AS (
  SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL)
  ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {TRUSTED_DOCS}
), counts AS (
  SELECT b, count(*) AS r, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM trusted)) AS t FROM grams GROUP BY b
), sums AS (SELECT sum(r) AS r, sum(t) AS t FROM counts
), weight AS (
  SELECT b, CASE WHEN s.t > 0 THEN round(1e6 * (ln((c.t + 1.0::DOUBLE) / (s.t + {BUCKETS}.0::DOUBLE)) - ln((c.r + 1.0::DOUBLE) / (s.r + {BUCKETS}.0::DOUBLE))))::BIGINT ELSE 0 END AS weight
  FROM counts c, sums s
), score AS (
  SELECT doc_id, sum(weight)::BIGINT AS total, count(*) AS n FROM grams JOIN weight USING (b) GROUP BY doc_id
), wins AS (
  SELECT doc_id, i, array_to_string(w[i : i + {REPEAT - 1}], chr(31)) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {REPEAT - 2})) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range({REPEAT}) r(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(score.total, 0) AS total, coalesce(score.n, 0) AS n
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN score USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND total >= {THRESHOLD} * n AS kept,
  CASE WHEN n > 0 THEN round(total::DOUBLE / n)::BIGINT ELSE 0 END AS score_millionths
FROM base
"""
