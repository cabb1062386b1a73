import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pairloom.llm import token_store
from pairloom.llm.queries import QUERIES
from pairloom.llm.shared import fresh_path

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_codes_give_back_every_id():
    rng = np.random.default_rng(1)
    for ids in (np.array([], np.uint32), np.array([0]), rng.integers(0, 256, 700), rng.integers(0, 50_000, 5000), np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1] * 100)):
        ids = ids.astype(np.uint32)
        segment = token_store.Segment(*token_store.to_levels(ids))
        assert segment.all().tolist() == ids.tolist()
        assert [segment[i] for i in range(len(ids))] == ids.tolist()


def test_store(spark, library):
    rng = random.Random(4)
    texts = [None, "", "<|endoftext|>", "hello world", "\x1c \x85x", "ünï côdé 日本"] + [" ".join(rng.choices(["the", "cat", "Ænea", "x,y"], k=rng.randint(0, 300))) for _ in range(60)]
    rows = [(i * 7 % 61, t, "z") for i, t in enumerate(texts)] + [(None, "no id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    path = token_store.write(df, fresh_path(spark, "store"), model_path=PATH, segment_tokens=500)
    assert token_store.open_store(spark, path)[0].count() > 8
    got = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r.start)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((r[0] or -1, ids(r[1])) for r in rows)
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    once = {k: v for k, v in ((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got if r.doc_id is not None and sum(x.doc_id == r.doc_id for x in got) == 1)}
    wanted = [(d, p) for d in once for p in (0, len(once[d]) // 2, len(once[d]) - 1, len(once[d]), -1)] + [(999, 0)]
    found = token_store.read_tokens(spark, path, spark.createDataFrame(wanted, "doc_id long, position long")).collect()
    assert len(found) == len(wanted)
    for r in found:
        assert r.token_id == (once[r.doc_id][r.position] if r.doc_id in once and 0 <= r.position < len(once[r.doc_id]) else None)


ODD = ["İ", "i", "I", "s", "ß", "ẞ", "\u0307", "\u0301", "\u0327", "\x1c", "\x1d", "\x1e", "\x1f", " ", "  ", "\t", "\n", "\x85", "\xa0", "'", "'s", "a", "É", "Ǆ", "Σ", "ς", ",", ".", "1", "<|endoftext|>", "日", "ŉ", "ﬁ", "\u2028", "Ⱥ"]


def test_odd_characters(library):
    rng = random.Random(5)
    texts = ["İstanbul", "x İstanbul İ", "a.\x1cb", "\t.\x1c."] + ["".join(rng.choices(ODD, k=rng.randint(1, 9))) for _ in range(8000)]
    with open(PATH) as f:
        encoder = token_store.IdEncoder(f.read())
    for text, ids in zip(texts, encoder.table.each(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_empty_store(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.read_documents(spark, token_store.write(df, fresh_path(spark, "store"), model_path=PATH)).count() == 0


def test_query(spark, sf_dir, library):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(QUERIES["op6_token_store"](spark, sf_dir).collect())
    start = 0
    for d, r in zip(docs, got, strict=True):
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_other_tokenizers_go_without_the_cache(spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    texts = ["hello world again", " two  words\n", "", "One"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    path = token_store.write(df, f"file://{tmp_path}/store", model_path=P.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in token_store.read_documents(spark, path).collect()}
    assert all(got[i] == [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts))
