"""A corpus from raw documents to token ids, in stages that are each written and read again.

Each stage works on all documents that its predecessor kept. Null and empty texts are clean, have one empty
line, and are exact copies of each other (the smallest doc_id stays); rows without doc_id pass every stage;
an empty table gives no rows; further columns are passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundwave.llm import bpe, decontaminate, linededup, nearcopies, toxicity
from boundwave.llm.common import drop_table, table, without, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer takes for toxic go."""
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"))
    kept = toxicity.scores(docs, scorer).where("score < 0.5").drop("doc_id", "score")
    return kept.toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document has too go; every document stays."""
    done = linededup.dedup_lines(docs)
    fresh = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*(fresh.get(c, F.col(f"rest.c{i}")).alias(c) for i, c in enumerate(docs.columns)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest document stays."""
    return nearcopies.without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return without(docs, found)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the texts decoded from them."""
    return bpe.round_trip(docs, bpe.vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", encode),
]

#: Trained scores and library tokens are beyond SQL; the tests hold run() against a chain of brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return done
        before, docs = docs, written(done)
        if i:
            drop_table(before)
    return docs
