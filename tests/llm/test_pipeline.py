"""Every stage of the pipeline against a brute-force version, and the run as a whole."""
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pastcast.llm.tokens import Encoder

from .test_free import brute_simhash, components_of, leak_corpus, toxic_corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    toxic, labels = toxic_corpus(spark)
    leaky, items, _ = leak_corpus(spark)
    shifted = leaky.filter("doc_id IS NOT NULL AND doc_id < 300").withColumn("doc_id", F.col("doc_id") + 2000)
    docs = toxic.filter("doc_id < 300").union(shifted).union(shifted.limit(20).withColumn("doc_id", F.col("doc_id") + 3000))
    docs.withColumn("source", F.concat(F.lit("s"), F.pmod("doc_id", F.lit(3)))).select(*COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_one_by_one(spark, folder):
    docs, names = spark.read.parquet(f"{folder}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_dedup", "decontamination", "mixing", "token_output"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), name)
        assert docs.columns == COLUMNS
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            gone = {r.doc_id for r in before.collect()} - kept[name].keys()
            assert {i for i in range(300) if i % 5 == 0} <= gone | {3} and len([i for i in gone if i >= 300 or i % 5]) <= 2
        if name == "simhash_dedup":
            prints = {r.doc_id: brute_simhash(r.text) for r in before.collect()}
            ids = sorted(prints)
            root = components_of([(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4], ids)
            assert set(kept[name]) == set(root.values())
        if name == "decontamination":
            planted = {2000 + i for i in range(0, 150, 3)} | {2070}
            assert not planted & kept[name].keys()
            assert kept["simhash_dedup"].keys() - kept[name].keys() <= planted | {i + 3000 for i in planted}
    mixed, words = docs.collect(), lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for r in kept["decontamination"].values():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    from .test_native import brute_targets
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 256
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    encoder, at = Encoder(), 0
    expected = sorted((r.doc_id, zlib.crc32(np.array([*encoder.tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes()))
                      for r in mixed)
    assert sorted((r.doc_id, r.ids_crc32) for r in out) == expected
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run_again_gives_the_same(spark, folder):
    once, again = (sorted(map(str, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert once and once == again


def test_stages_on_odd_tables(spark, folder, odd_docs, no_docs):
    """Nulls, empty and very long texts, repeated ids, clashing columns, no rows at all."""
    for docs in (odd_docs, no_docs):
        columns, schema = docs.columns, docs.dtypes
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialise(stage(spark, docs, folder), name)
            assert docs.columns == columns and docs.dtypes == schema
            if name != "mixing":
                assert {r.score for r in docs.collect()} <= {"x"}
        out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert out.count() == docs.count()


def test_toxicity_leaves_columns_of_its_names_alone(spark, folder):
    docs = spark.createDataFrame([(1, "a calm text about rivers", 7.5, "yes"), (2, "you are a stupid worthless idiot and moron", 1.5, "no")],
                                 "doc_id bigint, text string, score double, predicted string")
    out = corpus_pipeline.toxicity(spark, docs, folder).collect()
    assert [(r.doc_id, r.score, r.predicted) for r in out] == [(1, 7.5, "yes")]
