"""Exact top-k search by integer inner product over a bit-sliced index.

Vectors become integers, floor(scale * x). Rows are dealt over blocks by hash; a block keeps one bitmap over its rows
for each bit of each component (in offset form, so that all bits count positively), and the row ids in ascending
order. A query's score for all rows of a block is a sum of bitmaps: the query's components are written in signed binary
digits, and each digit adds the component's slices, or their complements, at its weight. Slices of one weight are added three
at a time by full adders, the carries go to the next weight. What the offsets and complements add is one constant for
the query, so the sums rank the rows.

The best rows are selected from the most significant slice of the sums downward: rows that have the bit, among those
still undecided, are taken if they are no more than wanted, else the others are ruled out. Rows that are
undecided after the last slice tie exactly, and the smallest ids of them fill up. The sums at the chosen rows
are the exact scores. The best of all blocks are merged for each query.

Queries are dealt over blocks too; every block of rows meets every block of queries, as a search over all rows must,
and only what a block selects moves on. Vectors that are null or empty, hold a null or non-finite component, or have a
null id, take no part; only vectors of one length are compared. Integers and sums are exact at any magnitude; vectors with
large components have blocks of their own, with more slices. A score beyond a long is told as the nearest long, and
ranked by its logarithm. Rows with
the query's id are not its candidates. Repeated rows are candidates each. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
LONG = (1 << 63) - 1
INDEX = "dim int, block int, n int, bits int, ids binary, slices binary"


def usable_vectors(df: DataFrame, *, vec_id: str, vector: str) -> DataFrame:
    """vec_id, dim, x (doubles) of the vectors that take part."""
    fine = F.col(vec_id).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = df.where(fine).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("x"))
    return rows.select("vec_id", F.size("x").alias("dim"), "x")


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as long integers or, where one needs more bits than those have, as Python's."""
    if np.abs(x).max(initial=0) * scale < 1 << 60:
        return np.floor(x * float(scale)).astype(np.int64)
    exact = [n * scale // d for n, d in map(float.as_integer_ratio, x.ravel().tolist())]
    return np.array(exact, object).reshape(x.shape)


def to_slices(ints: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of bits and the bitmaps (dim x bits x words) of the rows' components, offset to be non-negative."""
    rows, dim = ints.shape
    bits = int(max(int(ints.max(initial=0)), -int(ints.min(initial=0)) - 1, 0)).bit_length() + 1
    words = -(-rows // 64)
    up = (ints + (1 << (bits - 1))).T  # dim x rows
    slices = np.zeros((dim, bits, words * 8), np.uint8)
    for i in range(bits):
        packed = np.packbits((up >> i & 1).astype(np.uint8), axis=1, bitorder="little")
        slices[:, i, : packed.shape[1]] = packed
    return bits, slices.view(np.uint64)


def build_index(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, rows_per_block: int = 8192) -> tuple[DataFrame, int]:
    """The index, a row for each block, and the number of blocks."""
    rows = usable_vectors(df, vec_id=vec_id, vector=vector)
    blocks = max(1, -(-df.count() // rows_per_block))

    def block(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        dim = table.column("dim")[0].as_py()
        ints = whole(table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dim), scale)
        order = np.argsort(ids, kind="stable")
        bits, slices = to_slices(ints[order])
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": table.column("block").slice(0, 1).cast(pa.int32()), "n": pa.array([len(ids)], pa.int32()), "bits": pa.array([bits], pa.int32()), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "slices": pa.array([slices.tobytes()], pa.binary())})

    most = F.array_max(F.transform("x", F.abs)) * scale
    size = F.when(most < 1 << 15, 0).when(most < 1 << 60, 1).otherwise(2)  # of one block as many slices as its largest needs
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int")).withColumn("magnitude", size)
    return dealt.groupBy("dim", "block", "magnitude").applyInArrow(block, INDEX), blocks


def signed_digits(q: int) -> list[tuple[int, int]]:
    """(position, 1 or -1) of the non-adjacent form of ``q``, which has the fewest digits."""
    out, at = [], 0
    while q:
        if q & 1:
            digit = 2 - (q & 3)
            out.append((at, digit))
            q -= digit
        q >>= 1
        at += 1
    return out


def sums(query: list[int], slices: np.ndarray, bits: int) -> tuple[list[np.ndarray], int]:
    """Slices of the sum for all rows, least significant first, and what to add to get the inner product."""
    plus, minus, constant = [], [], 0
    for d, q in enumerate(query):
        constant -= q << (bits - 1)
        for at, digit in signed_digits(q):
            (plus if digit > 0 else minus).append((d, at))
            if digit < 0:
                constant -= ((1 << bits) - 1) << at
    pd, pa_ = (np.array([x[i] for x in plus], np.int64) for i in (0, 1))
    md, ma = (np.array([x[i] for x in minus], np.int64) for i in (0, 1))
    top = max([a for _, a in plus + minus], default=0) + bits
    carried: list[np.ndarray] = []
    out: list[np.ndarray] = []
    weight = 0
    while weight < top or carried:
        own = carried
        a, b = weight - pa_, weight - ma
        use_a, use_b = (a >= 0) & (a < bits), (b >= 0) & (b < bits)
        if use_a.any():
            own = [*own, slices[pd[use_a], a[use_a]]]
        if use_b.any():
            own = [*own, slices[md[use_b], b[use_b]] ^ ONES]
        carried = []
        if own:
            column = own[0] if len(own) == 1 else np.concatenate(own)
            while len(column) > 2:
                third = len(column) // 3
                x, y, z = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
                either = x ^ y
                carried.append((x & y) | (either & z))
                column = np.concatenate((either ^ z, column[3 * third :]))
            if len(column) == 2:
                carried.append((column[0] & column[1])[None])
                column = (column[0] ^ column[1])[None]
            out.append(column[0])
        else:
            out.append(np.zeros(slices.shape[2], np.uint64))
        weight += 1
    return out, constant


def select(total: list[np.ndarray], open_rows: np.ndarray, k: int) -> np.ndarray:
    """The positions of the k largest sums among the open rows, ties to the smallest positions."""
    taken, tied = np.zeros_like(open_rows), open_rows
    count = lambda m: int(np.bitwise_count(m).sum())
    if count(tied) > k:
        for plane in reversed(total):
            have = tied & plane
            n = count(taken | have)
            if n > k:
                tied = have
            else:
                taken |= have
                tied = tied & ~plane
                if n == k:
                    tied = np.zeros_like(tied)
                    break
    positions = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    sure = positions(taken)
    return np.concatenate((sure, positions(tied)[: k - len(sure)]))


def magnitude(x: int) -> float:
    """Grows with ``x`` beyond what a long holds: its sign times its logarithm, to some 12 digits."""
    return math.log2(abs(x)) * (1 if x > 0 else -1) if abs(x) >= LONG else 0.0


def search_block(ids: np.ndarray, slices: np.ndarray, bits: int, names: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list]:
    """(which query, row id, score) of each query's k best rows of a block."""
    n = len(ids)
    everything = np.packbits(np.ones(n, np.uint8), bitorder="little")
    everything = np.pad(everything, (0, slices.shape[2] * 8 - len(everything))).view(np.uint64)
    which, rows, scores = [], [], []
    for i, (name, query) in enumerate(zip(names.tolist(), queries.tolist(), strict=True)):
        total, constant = sums(query, slices, bits)
        open_rows = everything.copy()
        for p in range(np.searchsorted(ids, name), np.searchsorted(ids, name, "right")):
            open_rows[p >> 6] &= ~np.uint64(1 << (p & 63))
        for p in select(total, open_rows, k).tolist():
            word, bit = p >> 6, p & 63
            which.append(i)
            rows.append(int(ids[p]))
            scores.append(sum((int(plane[word]) >> bit & 1) << w for w, plane in enumerate(total)) + constant)
    return which, rows, scores


def search(index: DataFrame, blocks: int, queries: DataFrame, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, queries_per_block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of the index. Equal queries count once."""
    asked = usable_vectors(queries, vec_id=vec_id, vector=vector).distinct()
    groups = max(1, -(-queries.count() // queries_per_block))

    def pack(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        x = table.column("x").combine_chunks().flatten().to_numpy().astype("<f8")
        return pa.table({"dim": pa.array([dim], pa.int32()), "part": table.column("part").slice(0, 1).cast(pa.int32()), "names": pa.array([table.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), "asked": pa.array([x.tobytes()], pa.binary())})

    packed = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), F.lit(groups)).cast("int")).groupBy("dim", "part").applyInArrow(pack, "dim int, part int, names binary, asked binary")
    sent = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Spark takes the sent queries for as small as before explode(), and would broadcast them, through the driver. By merge
    # nothing goes there, and with the index on the right a task buffers one block, not all queries.
    met = sent.join(index.hint("merge"), ["dim", "block"])

    @F.arrow_udf("array<struct<query_id: bigint, key: bigint, vec_id: bigint, score: bigint, size: double>>")
    def best(dims: pa.Array, bits: pa.Array, ids: pa.Array, slices: pa.Array, names: pa.Array, wanted: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for d, b, i, s, n, q, part in zip(dims, bits, ids, slices, names, wanted, parts, strict=True):
            own = np.frombuffer(i.as_py(), "<i8")
            planes = np.frombuffer(s.as_py(), np.uint64).reshape(d.as_py(), b.as_py(), -1)
            names_ = np.frombuffer(n.as_py(), "<i8")
            which, rows, scores = search_block(own, planes, b.as_py(), names_, whole(np.frombuffer(q.as_py(), "<f8").reshape(-1, d.as_py()), scale), k)
            out.append([{"query_id": int(names_[w]), "key": part.as_py() << 32 | w, "vec_id": r, "score": max(-LONG - 1, min(LONG, x)), "size": magnitude(x)} for w, r, x in zip(which, rows, scores, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("query_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("size", pa.float64())])))

    found = met.select(F.explode(best("dim", "bits", "ids", "slices", "names", "asked", "part")).alias("x"), "dim").select("x.*", "dim")
    order = Window.partitionBy("query_id", "dim", "key").orderBy(F.col("score").desc(), F.col("size").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
