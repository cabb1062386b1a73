"""The corpus pipeline: from raw documents to the token ids of a mix of sources.

Each stage takes all that the one before it kept, as a Parquet table in the shared folder. Rows with nulls, empty
texts, repeated rows and extra columns pass through as the operators say. Where the labels have one value or none there
is nothing to learn: the quality classifier then keeps every document, and so does the toxicity filter.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import byte_bpe, byte_cnn, fair_mix, jaccard_join, toxicity
from pairloom.llm.learning import remainder
from pairloom.llm.shared import executors_give_back, give_back, removed, tables_made, vocabulary, written


def chosen(docs: DataFrame, scored: Callable[[DataFrame, str], DataFrame], keep: Column) -> DataFrame:
    """The rows of ``docs``, with all their columns as they are, whose score satisfies ``keep``.

    The columns get other names meanwhile, so that none is that of an output; each travels once.
    """
    names = [f"_{i}_{c}" for i, c in enumerate(docs.columns)]
    return scored(docs.toDF(*names), names[docs.columns.index("text")]).where(keep).select(*(F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns, strict=True)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from four fifths of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = byte_cnn.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    give_back()
    return chosen(docs, lambda rows, text: byte_cnn.scored(rows, net, text=text), F.col("score") >= byte_cnn.THRESHOLD)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the dictionaries come from two thirds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 3) != 1))
    give_back()
    return chosen(docs, lambda rows, text: toxicity.scored(rows, model, text=text), F.col("score") < toxicity.THRESHOLD)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more over five-word shingles, the one with the smallest id."""
    return jaccard_join.kept(docs, k=5, percent=80, file_keys=False)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents of the mix by weighted fair queueing; those that it repeats stand there twice."""
    return fair_mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by byte-level BPE."""
    from public_tokenizers import PATTERN

    encoded = byte_bpe.encoded(docs.select("doc_id", "source", "text"), ranks_path=vocabulary("byte_bpe_50k.tiktoken"), pattern=PATTERN, outputs=("n_tokens", "ids"))
    return encoded.drop("text")


def with_room(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, before which executors give back the memory that earlier ones needed."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        executors_give_back(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_classifier", with_room(quality)),
    ("toxicity", with_room(not_toxic)),
    ("ngram_jaccard_join", with_room(one_of_each_group)),
    ("source_mix", with_room(mix)),
    ("byte_bpe", with_room(tokens)),
]

#: Learned models, hash orders and vocabularies are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables that a later stage no longer reads are removed on the way."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with tables_made() as made:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        removed(spark, [*before, *made[:-1]])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
