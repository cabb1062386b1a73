"""Candidate pairs: by cosine over blocks of vectors, by equal keys, by time."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` rounded as Spark's ``round`` does, by the decimal form of each value: halves go away from zero."""
    scale = 10.0**digits
    y = np.abs(x) * scale
    out = np.floor(y + 0.5)
    close = np.abs(y - np.floor(y) - 0.5) < 1e-9 + y * 1e-15
    if close.any():
        values, at = np.unique(np.abs(x)[close], return_inverse=True)
        out[close] = np.array([float((Decimal(repr(v)) * 10**digits).to_integral_value(ROUND_HALF_UP)) for v in values.tolist()])[at]
    return np.copysign(out / scale, x) + 0.0


def block_pairs(df: DataFrame, block: int, *, key: str, vector: str, by: str | None = None) -> DataFrame:
    """key, v, own, g, i, j: the rows dealt over blocks by hash within each value of ``by``, each once for every block that its block meets."""
    sizes = df.groupBy(by).count().agg(F.max("count")) if by else df.agg(F.count("*"))
    blocks = max(1, -(-(sizes.first()[0] or 0) // block))
    rows = df.where(F.col(vector).isNotNull() & (F.col(by).isNotNull() if by else F.lit(True)))
    rows = rows.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("v"), (F.col(by) if by else F.lit(0)).alias("g")).withColumn("own", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("g", "key", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Ids and vectors (in double precision) of a task's two blocks, and whether they are one."""
    ids, own = table.column("key").to_numpy(), table.column("own").to_numpy()
    x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(ids), -1)
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    return ids[left], x[left], ids[right], x[right], i == j


def cosine_pairs(df: DataFrame, low: float, high: float | None = None, *, key: str = "id", vector: str = "v", block: int = 4096, digits: int = 6, by: str | None = None, closed: bool = False) -> DataFrame:
    """a < b and similarity of pairs of unit vectors with low <= dot < high (or <= high if ``closed``), on unrounded sums; every
    pair (with ``by``: of rows with equal values there, null equals nothing) is compared.

    Rows are dealt over blocks by hash and block meets block in a task of its own, as one product of matrices. Each
    vector goes to as many tasks as there are blocks; only pairs of the band leave a task.
    """
    top = float("inf") if high is None else float(np.nextafter(high, np.inf)) if closed else high

    def meet(table: pa.Table) -> pa.Table:
        ids, x, others, y, same = sides(table)
        out = [[], [], []]
        for at in range(0, len(ids), 512):
            dots = x[at : at + 512] @ y.T
            p, q = np.nonzero((dots >= low) & (dots < top))
            a, b = ids[at + p], others[q]
            keep = a < b if same else a != b
            for o, v in zip(out, (np.minimum(a, b)[keep], np.maximum(a, b)[keep], dots[p, q][keep]), strict=True):
                o.append(v)
        a, b, s = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "similarity": pa.array(s.astype(np.float64))})

    return block_pairs(df, block, key=key, vector=vector, by=by).groupBy("g", "i", "j").applyInArrow(meet, "a bigint, b bigint, similarity double").withColumn("similarity", F.round("similarity", digits))


def pairs_by_key(df: DataFrame, keys: list[Column], extra: list[str], *, order: str = "id") -> DataFrame:
    """Pairs (a_*, b_*) of rows with equal keys, the smaller ``order`` first. An equi-join, so AQE may split a crowded key."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.withColumns(dict(zip(names, keys, strict=True)))
    side = lambda p: rows.select(*names, *[F.col(c).alias(f"{p}_{c}") for c in dict.fromkeys([order, *extra])])
    return side("a").join(side("b"), names).where(F.col(f"a_{order}") < F.col(f"b_{order}")).drop(*names)


def pair_id(a: Column, b: Column) -> Column:
    """``a--b``; an id that holds the separator is an error."""
    checked = lambda x: F.when(x.cast("string").contains("--"), F.raise_error(F.lit("separator in id")).cast("string")).otherwise(x.cast("string"))
    return F.concat(checked(a), F.lit("--"), checked(b))


def best_of_rows(dots: np.ndarray, ids: np.ndarray, k: int, floor: float, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and similarity of each row's k largest products of at least ``floor``, as rounded, ties to the smaller id.

    The k-th largest of the maxima of some slices of a row is a bound that k of its products reach; only what reaches
    it, as rounded, is put in order.
    """
    cuts = np.arange(0, dots.shape[1], max(1, dots.shape[1] // max(64, 2 * k)))
    tops = np.fmax.reduceat(dots, cuts, axis=1)
    bound = np.full(len(dots), floor) if len(cuts) < k else np.maximum(floor, np.partition(np.nan_to_num(tops, nan=-np.inf, neginf=-np.inf, posinf=np.inf), -k, axis=1)[:, -k] - 2 * 10.0**-digits)
    p, q = np.nonzero((dots >= bound[:, None]) & (dots >= floor) & (dots > -np.inf))
    near = dots[p, q]
    s = half_up(near, digits)
    order = np.lexsort((ids[q], -s, p))
    p, q, s = p[order], q[order], s[order]
    place = np.arange(len(p)) - np.searchsorted(p, p)
    return p[place < k], q[place < k], s[place < k]


def knn(df: DataFrame, k: int, *, floor: float = float("-inf"), key: str = "id", vector: str = "v", block: int = 8192, digits: int = 6) -> DataFrame:
    """src, dst, similarity, rank of each vector's k nearest by dot product (rounded), ties to the smaller id.

    Block meets block as in ``cosine_pairs``; a task keeps the k best of each of its vectors, for either side.
    """
    def meet(table: pa.Table) -> pa.Table:
        ids, x, others, y, same = sides(table)
        out = [[], [], []]
        for a, u, b, v in [(ids, x, others, y)] + ([] if same else [(others, y, ids, x)]):
            for at in range(0, len(a) if len(b) else 0, 256):
                dots = u[at : at + 256] @ v.T
                if same:
                    dots[a[at : at + 256, None] == b[None, :]] = -np.inf
                p, q, s = best_of_rows(dots, b, k, floor, digits)
                for o, c in zip(out, (a[at + p], b[q], s), strict=True):
                    o.append(c)
        a, b, s = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({"src": pa.array(a.astype(np.int64)), "dst": pa.array(b.astype(np.int64)), "similarity": pa.array(s.astype(np.float64))})

    best = block_pairs(df, block, key=key, vector=vector).groupBy("g", "i", "j").applyInArrow(meet, "src bigint, dst bigint, similarity double")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.col("similarity").desc(), "dst"))).where(F.col("rank") <= k)
