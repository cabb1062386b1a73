import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import prefix_counts
from pairloom.llm.queries import QUERIES

PATH = P.path("word_bpe_49k.json")
TEXTS = [None, "", "  ", "Hello world, isn't it?", "we'll we're 'll 'reality 've'd ''s '", "naïve ÉCOLE Straße İstanbul", "日本語テキスト 🙂👍🏽 مرحبا", "été öl", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext", "\x1c\x1dx \x85y\xa0z", "antidisestablishmentarianism " * 3, "x" * 150, "12345 ⅷ² ٣", "ΣΑΣ Σ", "À́b̧", "q'LL Q'Re"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return prefix_counts.PrefixCounter(open(PATH).read())


def test_every_prefix_matches_the_library(library, counter):
    rng = random.Random(2)
    alphabet = "aaeinstlrdvm''ABÉßöü日🙂́ \n\x1c.,!-0٣"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(400)]
    for text in texts:
        counts = prefix_counts.counts_in(counter.table(text))
        assert len(counts) == len(text) + 1
        for k in range(len(text) + 1):
            assert counts[k] == len(library.encode(text[:k], add_special_tokens=False).ids), (text, k)


def test_totals_of_documents(library, counter, spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        counts = prefix_counts.counts_in(counter.table(r.text))
        for k in (len(r.text) // 3, len(r.text)):
            assert counts[k] == len(library.encode(r.text[:k], add_special_tokens=False).ids)


def test_frames(spark, library):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, n_tokens int")
    out = prefix_counts.with_prefix_counts(df, model_path=PATH)
    out = prefix_counts.cut_to_budget(prefix_counts.tokens_in_prefix(out.withColumn("k", F.lit(5)), "k"), 4)
    rows = out.collect()
    assert len(rows) == 2 * len(TEXTS)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in rows:
        text = r.text or ""
        assert r.n_tokens == size(text) and r.prefix_tokens == size(text[:5])
        fitting = [k for k in range(len(text) + 1) if size(text[:k]) <= 4]
        assert (r.cut_text or "") == text[: fitting[-1]]
    assert prefix_counts.with_prefix_counts(df.limit(0), model_path=PATH).count() == 0


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op4_prefix_counts"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def test_other_models_are_refused(spark):
    import public_tokenizers as P
    import pytest

    with pytest.raises(ValueError, match="preparation"):
        prefix_counts.with_prefix_counts(spark.createDataFrame([("a",)], "text string"), model_path=P.path("byte_bpe_50k.json"))
