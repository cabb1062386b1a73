import random
import re

import numpy as np
import pytest

from pairloom.llm import jaccard_join
from pairloom.llm.queries import QUERIES


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def by_hand(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root, links = [*range(len(rows))], [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                inter = len(sets[a] & sets[b])
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 60))
    common = [word() for _ in range(60)]
    out = [None, "", " \t\n", "one", "ONE", "one two", "One\x0btwo", "a b c", "é É", "a\x1cb c d"]
    while len(out) < n:
        own = [word() for _ in range(rng.choice([2, 4, 9, 20, 60, 200]))]
        if rng.random() < 0.4:
            own[3:3] = common
        for _ in range(rng.choice([1, 1, 1, 2, 6])):
            copy = own[:]
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out[:n]


@pytest.mark.parametrize(("k", "percent", "blocks"), [(3, 90, (8192, 1024)), (5, 80, (4, 3)), (1, 70, (8192, 1024))])
def test_against_brute_force(spark, k, percent, blocks):
    rows = [*enumerate(texts(k, 400), 10)]
    rows += [(5000 + i, rows[30 + i % 3][1]) for i in range(40)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_shingles string").repartition(5)
    got = jaccard_join.join(df, k=k, percent=percent, key_block=blocks[0], group_block=blocks[1], file_keys=k != 5).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == by_hand(rows, k, percent)


def test_crowded_keys_and_groups(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1500):
        copy = base[:]
        if i % 3:
            copy[59] = f"x{rng.randint(0, 400)}"
        rows.append((i, " ".join(copy)))
    rows += [*enumerate(texts(9, 300), 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    exploded = jaccard_join.with_sets(df, text="text", k=3, rule=jaccard_join.Rule(90), outputs=("node", "keys")).selectExpr("explode(keys) AS key", "node AS rep")
    assert jaccard_join.crowded_keys(exploded, every=4).count() > 0
    got = jaccard_join.join(df, group_block=128, block_bytes=1 << 16).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == by_hand(rows, 3, 90)


def test_long_texts_in_small_blocks(spark):
    words = [f"w{i}" for i in range(30_000)]
    rows = [(i, " ".join([*words[: 30_000 - i], "z"])) for i in range(6)] + [(9, "one two three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.n_links) for r in jaccard_join.join(df, block_bytes=1 << 19).collect())
    assert got == [(i, 0, 5) for i in range(6)] + [(9, 9, 0)]


def test_sets_of_one_hash_are_told_apart(spark):
    df = spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "node long, check long")
    nodes = [r.node for r in jaccard_join.told_apart(df, [7]).collect()]
    assert len({*nodes}) == 3 and nodes[2] == 8


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, "a b c d e f", 1), (2, "a b c d e f", 1), (3, "x " * 100_000, 1), (4, None, 1)], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()), key=str)
    assert got == sorted([(1, 4, 1), (1, 4, 1), (0, 4, None), (2, 4, 1), (3, 1, 3), (4, 0, 4)], key=str)
    assert sorted(r.doc_id or 0 for r in jaccard_join.kept(df).collect()) == [0, 1, 3, 4]
    assert jaccard_join.join(df.limit(0)).count() == 0


def test_sketches_never_tell_too_much():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 400):
        for change in (0, 1, 5):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate((a[change:], rng.integers(0, 1 << 63, 2 * change).astype(np.uint64))))
            rows = jaccard_join.folded([jaccard_join.sketch(a), jaccard_join.sketch(b)])
            assert np.bitwise_count(rows[0] ^ rows[1]).sum() <= len(np.setxor1d(a, b))


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op2_jaccard_join"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == by_hand(rows, 3, 90)
