import os
import random

import numpy as np
import pytest

from pairloom.llm import byte_cnn
from pairloom.llm.learning import remainder
from pairloom.llm.queries import QUERIES


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join("".join(rng.choices("abcdeilmnorst", k=rng.randint(2, 8))) for _ in range(rng.randint(8, 150)))
        good = int(i % 4 != 0)
        rows.append((i, text if good else text.upper().replace(" ", "!! "), good, "x"))
    return rows


def test_learns_and_covers_whole_texts(spark):
    schema = "doc_id long, text string, quality int, score string"
    learn = spark.createDataFrame(made(400, 1), schema)
    net = byte_cnn.fit(learn.drop("quality"), learn.select("doc_id", "quality"), epochs=4)
    test = made(200, 2)
    got = byte_cnn.scored(spark.createDataFrame(test, schema), net).collect()
    assert sum((r.score >= byte_cnn.THRESHOLD) == (r.quality == 1) for r in got) >= 0.97 * len(got)
    odd = [(1, None), (2, ""), (3, "a"), (4, "abc der " * 40_000), (5, "abc der " * 40_000 + "QX!! ZORT!! "), (4, "abc der " * 40_000)]
    rows = byte_cnn.scored(spark.createDataFrame(odd, "doc_id long, text string").coalesce(1), net).collect()
    assert all(0 <= r.score <= 1 for r in rows) and rows[3] == rows[5] and rows[0].score == rows[1].score
    assert rows[3].n_chunks >= 320_000 // net.chunk and rows[4].score != rows[3].score  # its very end counts
    empty = spark.createDataFrame([], schema)
    assert byte_cnn.fit(empty, empty) is None and byte_cnn.scored(empty, None).count() == 0
    assert {r.score for r in byte_cnn.scored(learn, None).collect()} == {1.0}


def test_blocks_change_nothing():
    rng = np.random.default_rng(0)
    net = byte_cnn.ByteCnn(rng.normal(size=(256, 4)).astype("f4"), rng.normal(size=(24, 5)).astype("f4"), rng.normal(size=5).astype("f4"), rng.normal(size=10).astype("f4"), 0.1, 6, 2, 32)
    for n in (1, 6, 7, 33, 2048, 2090, 5000):
        raw = rng.integers(0, 256, n).astype(np.uint8)
        raw_padded = raw if n >= 6 else np.concatenate((raw, np.zeros(6 - n, np.uint8)))
        answers = np.array([net.embedding[raw_padded[i : i + 6]].ravel() @ net.filters for i in range(0, len(raw_padded) - 5, 2)])
        tops = np.array([np.maximum(answers[a : a + 16].max(0) + net.bias, 0) for a in range(0, len(answers), 16)])
        highest, mean, chunks = net.pooled(raw)
        assert chunks == len(tops) and np.allclose(highest, tops.max(0), atol=1e-4) and np.allclose(mean, tops.mean(0), atol=1e-4)


def plain_score(net, text):
    """Every chunk by itself: places of all its bytes, maximum by chunk, then maximum and mean over the document."""
    raw = [*(text or "").encode()]
    raw += [0] * (net.width - len(raw))
    places = [np.concatenate([net.embedding[b] for b in raw[i : i + net.width]]) @ net.filters for i in range(len(raw) - net.width + 1)]
    tops = [np.maximum(np.max(places[a : a + net.chunk], axis=0) + net.bias, 0) for a in range(0, len(places), net.chunk)]
    z = float(np.concatenate((np.max(tops, axis=0), np.mean(tops, axis=0))) @ net.out + net.shift)
    p = 1 / (1 + np.exp(-max(-30, min(30, z))))
    return 0.3 * p / net.cut if p < net.cut else 0.3 + 0.7 * (p - net.cut) / (1 - net.cut)


def test_learns_from_the_end_of_long_texts(spark):
    rng = random.Random(3)
    filler = ["".join(rng.choices(["ba", "ko", "li", "ren", "tos"], k=2)) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(filler, k=1200)) + (" !!QX!! ZORT!!" if i % 3 == 0 else ""), int(i % 3 != 0)) for i in range(150)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(8)
    got = byte_cnn.scored(learn, byte_cnn.fit(learn, learn, epochs=8)).collect()
    assert sum((r.score >= byte_cnn.THRESHOLD) == (r.quality == 1) for r in got) >= 0.95 * len(got)


def test_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("out", remainder("doc_id", 5) == 0)
    found = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = byte_cnn.fit(docs, found.where(remainder("doc_id", 5) != 0))
    got = {r.doc_id: r for r in QUERIES["op8_byte_cnn"](spark, sf_dir).collect()}
    docs = docs.collect()
    assert len(got) == len(docs) and all(got[d.doc_id].held_out == d.out for d in docs)
    for d in docs[:60]:
        assert abs(got[d.doc_id].score - plain_score(net, d.text)) < 1e-3 and got[d.doc_id].predicted == int(got[d.doc_id].score >= 0.3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_recall_on_held_out_rows(spark):
    where = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op8_byte_cnn"](spark, where).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    out = [got[k] for k in labels if k in got and got[k].held_out]
    good, bad = ([r for r in out if labels[r.doc_id] == k] for k in (1, 0))
    assert sum(r.predicted for r in good) >= 0.95 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.85 * len(bad)
