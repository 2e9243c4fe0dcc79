"""Documents to training windows, in five stages.

Toxic documents go; of near duplicates one stays; personal data is put in
brackets; sources are mixed to target weights; the mixture is packed. Each
stage works on all that the stage before it kept, which is written as Parquet
to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm import mixing, ngram_join, packing, pii, toxicity
from quill.llm.common import documents, stored


#: Documents that go to a Python worker together, at most. Arrow buffers on both sides hold that many whole texts.
ROWS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ROWS_PER_BATCH rows, unless they are smaller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    known = int(spark.conf.get(key))
    if not 0 < known <= ROWS_PER_BATCH:  # 0: no limit
        spark.conf.set(key, str(ROWS_PER_BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose score reaches the threshold; the model is trained on labelled rows of docs.

    Null and empty texts have the score of no sentence. Repeated rows are scored alike; no rows give no rows.
    """
    small_batches(spark)
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select(F.struct(*docs.columns).alias("_row"))
    return toxicity.score(whole, model, ["_row"], inside="_row").filter(F.col("score") < toxicity.THRESHOLD).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 in five-word shingles, the one with the smallest id.

    Null texts and texts without words are linked with nothing and stay, repeated ones too. Of other repeated rows one stays.
    """
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data replaced by its kind. Null texts stay null, repeated rows stay."""
    small_batches(spark)
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time a document is taken. Null and empty texts have no words and are not taken; a null source is a source."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows. A null text is its end id alone."""
    small_batches(spark)
    return packing.pack(docs, packing.vocabulary_path())


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_duplicates), ("pii", redact), ("mixing", mix_sources), ("packing", pack)]

#: Models, tokenizers and sampling have no SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
