import base64
from collections import Counter

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard_join import by_hand


def test_stages_and_result(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("mine"))
    names = docs.columns
    seen, sizes = docs, [docs.count()]
    tables = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.written(stage(spark, seen, sf_dir), name)
        assert seen.columns == names
        tables.append({r.doc_id: r for r in seen.collect()})
        sizes.append(seen.count())
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i, r in labels.items() if r.quality == 1]
    assert sum(i in tables[0] for i in good) >= 0.85 * len(good)
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == len(tables[2]) and all(r.score == "mine" for r in tables[3].values())
    before = [(i, r.text) for i, r in tables[1].items()]
    assert {*tables[2]} == {c for _, _, c, _ in by_hand(before, 5, 80)}
    last = corpus_pipeline.STAGES[-1][1](spark, seen, sf_dir).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in seen.collect()) and max(Counter(r.doc_id for r in last).values()) <= 2
    for r in last:
        assert r.ids == library.encode_ordinary(tables[3][r.doc_id].text) and r.n_tokens == len(r.ids)


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids"] and got.count() > 0


def test_odd_rows(spark, sf_dir):
    rows = [(None, None, "en", None, 0), (1, "", None, "a", 0), (2, "Some words that are fine and kept here, in a short text.", "en", "a", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        seen = frame
        for name, stage in corpus_pipeline.STAGES:
            seen = corpus_pipeline.written(stage(spark, seen, sf_dir), name)
        seen.count()


def test_fits_give_their_memory_back(spark, sf_dir, monkeypatch):
    """What the fits leave free in the driver's Python goes back before the stages run."""
    seen = []
    for module in (corpus_pipeline.byte_cnn, corpus_pipeline.toxicity):
        monkeypatch.setattr(module, "fit", lambda *a, m=module, **b: seen.append(m))
    monkeypatch.setattr(corpus_pipeline, "chosen", lambda docs, *a: seen.append("scored"))
    monkeypatch.setattr(corpus_pipeline, "give_back", lambda: seen.append("back"), raising=False)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    corpus_pipeline.quality(spark, docs, sf_dir)
    corpus_pipeline.not_toxic(spark, docs, sf_dir)
    assert seen == [corpus_pipeline.byte_cnn, "back", "scored", corpus_pipeline.toxicity, "back", "scored"]


def test_stages_begin_with_collected_heaps(spark, sf_dir):
    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = spark.createDataFrame([(1, "s", "a b c"), (2, None, None)], "doc_id long, source string, text string")
    before = collections()  # the local master's executor is this Java machine
    dict(corpus_pipeline.STAGES)["byte_bpe"](spark, docs, sf_dir)
    assert collections() > before
