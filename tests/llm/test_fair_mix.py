import re
from collections import defaultdict

import pytest

from pairloom.llm import fair_mix
from pairloom.llm.queries import QUERIES


def by_hand(sizes: dict, share=1.5):
    """Targets by sharing the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / total for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_and_shares(spark):
    rows = [(i, " ".join(["w"] * (i * 37 % 90)), ("b", "a", "é", None, "zz")[min(i % 11, 4)], 5) for i in range(800)] + [(7, None, "a", 5), (8, "", "only-empty", 5), (9, "x\x1cy z\x85", "a", 5)] + [(3, "same row here", "b", 5)] * 6
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(7)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = fair_mix.schedule(df, rows_per_range=32).collect()
    assert len(got) == len(rows)
    want, taken, limit = by_hand(sizes), defaultdict(int), defaultdict(set)
    for r in got:
        taken[r.source] += r.taken
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        limit[r.source].add((r.virtual_finish, r.taken >= r.size))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert [r.virtual_finish for r in got] == sorted(r.virtual_finish for r in got)
    again = fair_mix.schedule(df.repartition(3), rows_per_range=32).collect()
    assert sorted((r.doc_id, r.text or "", r.taken) for r in again) == sorted((r.doc_id, r.text or "", r.taken) for r in got)


def test_mixed_rows(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 3 == 0]) for i in range(300)], "doc_id long, text string, source string")
    plan = {r.doc_id: round(r.taken / r.size) for r in fair_mix.schedule(df).collect()}
    rows = fair_mix.mixed(df).collect()
    count = defaultdict(int)
    for r in rows:
        count[r.doc_id] += 1
    assert rows[0].__fields__ == df.columns and dict(count) == {k: v for k, v in plan.items() if v}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert fair_mix.schedule(df).count() == 0 and fair_mix.mixed(df).count() == 0
    only = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.taken, r.target) for r in fair_mix.schedule(only).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_query(spark, sf_dir):
    got = QUERIES["op7_fair_mix"](spark, sf_dir)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    taken, sizes, target = defaultdict(int), defaultdict(int), {}
    for r in got.collect():
        s = source[r.doc_id]
        taken[s], sizes[s], target[s] = taken[s] + r.taken, sizes[s] + r.size, r.target
    want = by_hand(sizes)
    for s in want:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
