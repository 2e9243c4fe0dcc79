"""Every operator and stage on odd rows: nulls, empty and long texts, repeats, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quill.llm")

import corpus_pipeline  # noqa: E402
from quill.llm import fingerprints, licenses, mixing, ngram_join, packing, pii, quality, substrings, token_store, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, h string, score string, key int, label string, place int"


def rows():
    long_text = " ".join(f"word{i} and{i % 7}" for i in range(30_000))
    texts = ["", " \n\t ", None, "one", "a b c", long_text, "same text of some words here. " * 9, "same text of some words here. " * 9, "x" * 5000, "é à ü   ñ 漢字 \U0001f600 mit license"]
    out = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), 1, "h", "s", 2, "l", 3) for i, t in enumerate(texts)]
    out += [out[6], out[6]]  # repeated rows
    out += [(None, "no id at all but words", None, None, None, None, None, None, None, None, None), (3, "another text under a known id", "en", "s1", 5, 1, "h", "s", 2, "l", 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(8)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def per_row(docs, labels):
    flat = toxicity.Model(__import__("numpy").zeros(1 << 10), -3.0)
    return {
        "quality": lambda d: quality.quality(d, labels),
        "licenses": lambda d: licenses.scan(d),
        "token_store": lambda d: token_store.read_back(token_store.write_store(d, packing.vocabulary_path("word_bpe_49k.json"))),
        "fingerprints": lambda d: fingerprints.fingerprints(d),
        "toxicity": lambda d: toxicity.score(d, flat, ["doc_id"]),
        "pii": lambda d: pii.find(d),
        "redacted": lambda d: pii.redacted(d),
        "ngram_join": lambda d: ngram_join.join(d),
        "mixing": lambda d: mixing.taken(d),
        "substrings": lambda d: substrings.dedup(d),
    }


@pytest.mark.parametrize("name", ["quality", "licenses", "token_store", "fingerprints", "toxicity", "pii", "redacted", "ngram_join", "mixing", "substrings"])
def test_one_row_each(docs, labels, name):
    run = per_row(docs, labels)[name]
    got = run(docs)
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    assert ids(got) == ids(docs)
    assert run(docs.limit(0)).count() == 0


def test_packing(docs):
    got = packing.pack(docs, packing.vocabulary_path()).collect()
    assert len([r for r in got if r.start == 0]) == len(rows())
    assert packing.pack(docs.limit(0), packing.vocabulary_path()).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, docs, labels, tmp_path, name, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = stage(spark, docs, str(tmp_path))
    if name != "packing":
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    assert got.count() > 0
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_defined_results(docs, labels):
    by = lambda df: {(r.doc_id, i): r for i, r in enumerate(df.orderBy("doc_id").collect())}
    q = [r for r in quality.quality(docs, labels).collect() if r.doc_id in (0, 1, 2)]
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in q)
    f = [r for r in fingerprints.fingerprints(docs).collect() if r.doc_id in (0, 2)]
    assert all(r.n_chars == 0 and r.fingerprint == f[0].fingerprint for r in f)
    j = ngram_join.join(docs).filter(F.col("doc_id").isin(0, 1, 2, 6, 7)).collect()
    assert all(r.component_id == r.doc_id for r in j if r.doc_id < 3) and all(r.component_id == 6 for r in j if r.doc_id > 3)
    m = [r for r in mixing.taken(docs).collect()]
    assert all(r.taken == 0 for r in m if r["size"] == 0) and all(r.taken <= 3 * r["size"] for r in m)
    d = [r for r in substrings.dedup(docs).collect() if r.doc_id in (6, 7)]
    assert all(r.n_removed == r.n_bytes for r in d)
    assert len(by(docs)) == len(rows())
