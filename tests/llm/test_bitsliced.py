import math
from fractions import Fraction

import numpy as np

from pairloom.llm import bitsliced
from pairloom.llm.queries import ORACLE_SQL, QUERIES


def test_sums_and_selection():
    rng = np.random.default_rng(3)
    for dim, n, span in ((1, 5, 3), (7, 200, 300), (16, 64, 1), (3, 130, 1 << 30)):
        rows, query = rng.integers(-span, span + 1, (n, dim)), rng.integers(-span, span + 1, dim)
        bits, slices = bitsliced.to_slices(rows)
        total, constant = bitsliced.sums(query.tolist(), slices, bits)
        got = [sum((int(p[i >> 6]) >> (i & 63) & 1) << w for w, p in enumerate(total)) + constant for i in range(n)]
        assert got == [sum(int(a) * int(b) for a, b in zip(r, query)) for r in rows]


def by_hand(rows, queries, k):
    ok = [(i, [int(np.floor(256 * float(np.float64(x)))) for x in v]) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in ok if i in queries}:
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v)))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.round(rng.normal(0, 1, 6), 1 if i % 3 else 3).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[10][1]) for i in range(40)] + [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, [1.0, 2.0]), (2006, [2.0, 1.0]), (None, [1.0] * 6), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    index, blocks = bitsliced.build_index(df, rows_per_block=64)
    queries = {0, 7, 10, 50, 1003, 2000, 2003, 2005}
    got = bitsliced.search(index, blocks, df.where(df.vec_id.isin(*queries)), queries_per_block=3).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == by_hand(rows, queries, 5)
    few = df.where("vec_id IN (0, 1, 2)")
    index, blocks = bitsliced.build_index(few)
    assert len(bitsliced.search(index, blocks, few).collect()) == 6
    index, blocks = bitsliced.build_index(df.limit(0))
    assert bitsliced.search(index, blocks, df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = {tuple(r) for r in con.execute(f"SELECT query_id, rank, vec_id, score FROM ({ORACLE_SQL['op3_bitsliced']})").fetchall()}
    got = [tuple(r) for r in QUERIES["op3_bitsliced"](spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()]
    assert len(got) == len(want) and {*got} == want


def test_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100, [2.0**22] * 4), (101, [-(2.0**22)] * 4), (102, [2.0**23, 1.0, 0.5, -3.0]), (103, [2.0**40, 2.0**39, 0.0, 0.0]), (104, [1e300, -1e300, 0.0, 1.0]), (105, [1e300, 0.0, 0.0, 0.0]), (106, [5e-324, 0.0, 0.0, 0.0]), (107, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, blocks = bitsliced.build_index(df, rows_per_block=16)
    got = bitsliced.search(index, blocks, df, k=5, queries_per_block=16).collect()
    ints = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v in rows if i != 107}
    assert {r.query_id for r in got} == {*ints}
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for q, v in ints.items():
        want = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints.items() if i != q))[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, clip(-s)) for s, i in want]


def test_queries_are_not_broadcast(spark):
    """explode() sends a copy of the queries to each block, which Spark's estimate of their size leaves out."""
    rows = [(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, blocks = bitsliced.build_index(df, rows_per_block=16)
    found = bitsliced.search(index, blocks, df, queries_per_block=16)
    assert {tuple(r) for r in found.collect()} == by_hand(rows, {*range(200)}, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
