"""The corpus pipeline: documents in, token ids out, through five operators.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of docs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pastcast.llm.common import materialise, shared_path
from pastcast.llm.decontamination import remove_leaks
from pastcast.llm.mixing import mix_documents
from pastcast.llm.simhash import keep_one
from pastcast.llm.token_store import read_store, write_store
from pastcast.llm.toxicity import learn, score_texts


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labels that may be learned from, does not reject."""
    grammar = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # names that no column of the documents has
    score, predicted = (f"{name}_{len(''.join(docs.columns))}" for name in ("toxicity", "rejected"))
    return score_texts(docs, grammar, score_col=score, predicted_col=predicted).filter(f"{predicted} = 0").select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: four-word shingles, four bits."""
    return keep_one(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by their target weights, as documents of the words taken."""
    return mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a reader finds in the token files of the mix: doc_id, start, n_tokens, ids_crc32."""
    path = shared_path(spark, "pipeline-tokens")
    write_store(docs, path, end_id=2)
    return read_store(spark, path, with_ids=False)


STAGES = [("toxicity", toxicity), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination),
          ("mixing", mixing), ("token_output", token_output)]

#: Models, fingerprints and tokens are beyond SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
