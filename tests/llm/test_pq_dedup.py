import numpy as np

from pairloom.llm import pq_dedup
from pairloom.llm.components import components
from pairloom.llm.queries import QUERIES


def by_hand(rows, least=0.95):
    ok = [k for k, (i, v) in enumerate(rows) if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    scaled = {k: np.array(rows[k][1], float) / np.abs(np.array(rows[k][1], float)).max() for k in ok}
    units = {k: x / np.linalg.norm(x) for k, x in scaled.items()}
    root, links = {k: k for k in range(len(rows))}, [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(ok):
        for b in ok[n + 1 :]:
            if len(units[a]) == len(units[b]) and units[a] @ units[b] >= least:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = {}
    for k in ok:
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted(((i if i is not None else -1), links[k], (min(groups[find(k)]) if k in units else i) if i is not None else -1) for k, (i, _) in enumerate(rows))


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    rows = [(i * 3 % 601, (base[i % 30] + rng.normal(0, 0.04 + 0.03 * (i % 4), 16)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(50)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0, None] + [0.0] * 14), (2004, [float("nan")] * 16), (2005, [1.0, 0.0]), (2006, [2.0, 0.01]), (None, rows[5][1]), (3, rows[1][1]), (3, rows[1][1]), (2007, [1e200] * 16), (2008, [1e-200] * 16)]
    df = spark.createDataFrame([(i, v, "k") for i, v in rows], "vec_id long, embedding array<double>, kept string").repartition(3)
    for block in (4096, 16):  # the small blocks cut each list into many groups
        got = pq_dedup.near_duplicates(df, block=block, sample_rows=200).collect()
        assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in got) == by_hand(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert pq_dedup.near_duplicates(df.limit(0)).count() == 0


def test_distances_are_those_of_the_tables():
    rng = np.random.default_rng(4)
    x = pq_dedup.unit(rng.normal(size=(700, 20)))
    q = pq_dedup.fit(x[:400], 5)
    codes, error = q.residual_codes(x, np.full(700, 2))
    ends = list(zip([0, *q.edges[:-1]], q.edges, strict=True))
    rest = x[:50] - q.centroids[2]
    tables = [((rest[:, None, a:e] - book) ** 2).sum(2) for book, (a, e) in zip(q.books, ends, strict=True)]
    want = sum(t[:, codes[:, m]] for m, t in enumerate(tables))
    got = q.distances(x[:50], 2, q.decoded(codes))
    assert np.abs(got - want).max() < 1e-5
    true = np.sqrt(((x[:50, None] - x) ** 2).sum(2))
    assert (np.sqrt(np.maximum(got, 0)) - error <= true + 1e-4).all()  # so the filter loses no pair


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 202), (202, 200), (300, 300), (500, 499), (500, 498), (498, 497)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in [*range(41), 100]} | {200: 200, 201: 200, 202: 200} | {i: 497 for i in (497, 498, 499, 500)}
    assert got == want


def test_recall_of_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in QUERIES["op5_pq_dedup"](spark, sf_dir).collect())
    assert got == by_hand(rows)  # recall 1.0
