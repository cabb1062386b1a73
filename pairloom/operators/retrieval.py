"""Ranks and neighbours in vector spaces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .candidates import knn


def answer_ranks(queries: DataFrame, answers: DataFrame, pool: DataFrame, *, block: int = 4096) -> DataFrame:
    """query, rank of its answer among the pool's rows of its group: 1 and one for each distractor at least as near.

    ``queries`` (query, grp, v), ``answers`` (query, v), ``pool`` (id, grp, v; the query's and answer's own ids
    are excluded by ``queries.own``, an array). The pool is dealt over blocks; a block counts, nothing else moves.
    """
    q = queries.join(answers.select("query", F.col("v").alias("w")), "query")
    blocks = max(1, -(-pool.count() // block))
    p = pool.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).select("grp", "b", F.col("id").alias("key"), F.col("v").cast("array<double>").alias("v"), F.lit(None).cast("array<double>").alias("w"), F.lit(None).cast("array<bigint>").alias("own"), F.lit(False).alias("ask"))
    asked = q.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("grp", "b", F.col("query").alias("key"), F.col("v").cast("array<double>").alias("v"), F.col("w").cast("array<double>").alias("w"), F.col("own").cast("array<bigint>").alias("own"), F.lit(True).alias("ask"))

    def count(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        keys = table.column("key").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        out_k, out_n = [], []
        rows, at = np.flatnonzero(ask), np.flatnonzero(~ask)
        w, own = table.column("w"), table.column("own")
        for i in rows.tolist():
            answer = float(x[i] @ np.array(w[i].as_py()))
            near = x[at] @ x[i] >= answer
            out_k.append(int(keys[i]))
            out_n.append(int((near & ~np.isin(keys[at], own[i].as_py())).sum()))
        return pa.table({"query": pa.array(out_k, pa.int64()), "n": pa.array(out_n, pa.int64())})

    counts = asked.unionByName(p).groupBy("grp", "b").applyInArrow(count, "query bigint, n bigint")
    return counts.groupBy("query").agg((F.sum("n") + 1).cast("bigint").alias("rank"))


def rank_summary(ranks: DataFrame) -> DataFrame:
    r = F.col("rank")
    return ranks.agg(F.count("*").alias("n"), F.round(F.avg((r <= 5).cast("double")), 4).alias("recall_5"), F.round(F.avg((r <= 1).cast("double")), 4).alias("recall_1"), F.round(F.percentile(r, F.lit(0.5)), 4).alias("median_rank"), F.round(F.avg(r), 4).alias("mean_rank"), F.max(r).alias("max_rank"), F.round(F.avg(1 / r), 6).alias("mrr"))


def knn_distance(df: DataFrame, k: int = 5) -> DataFrame:
    """id, distance: 1 less the mean similarity to the k nearest others."""
    return knn(df, k).groupBy(F.col("src").alias("id")).agg(F.round(1 - F.avg("similarity"), 6).alias("distance"))


def null_quantiles(distances: DataFrame) -> DataFrame:
    return distances.agg(F.round(F.percentile("distance", F.lit(0.99)), 6).alias("q99"), F.round(F.percentile("distance", F.lit(0.01)), 6).alias("q01"))


def best_distractor(df: DataFrame) -> DataFrame:
    """id, best: the largest similarity to another row."""
    return knn(df, 1).select(F.col("src").alias("id"), F.round("similarity", 6).alias("best"))


def best_across(pairs: DataFrame, a: str = "a", similarity: str = "similarity") -> DataFrame:
    w = Window.partitionBy(a).orderBy(F.col(similarity).desc())
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def translation_gate(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs with ``accepted``: similarity at least ``least``."""
    return pairs.withColumn("accepted", F.col("similarity") >= least)
