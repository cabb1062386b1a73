import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from pairloom.llm import byte_bpe
from pairloom.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "  ", "\n\n  a", "a   b", "a   b", "Hello, world's end 123\n\n x", "naïve café — 日本語 🙂👍🏽 مرحبا", "a" * 500, "ab " * 300, "\x1c\x1d \x85 x  y", "<|endoftext|> hi", "don't we'll I'M", "é ́x", "x" * 60 + " " * 50 + "y"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.ByteBpe(byte_bpe.as_tokenizer_json(byte_bpe.read_ranks(byte_bpe.read_bytes(PATH)), P.PATTERN))


def test_ids_offsets_and_bytes_match_the_library(library, codec):
    rng = random.Random(3)
    alphabet = "aabcdeéß日🙂́‍ '\n\t 　\x1c.,!0123٣ⅷ²"
    for text in [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]:
        ids = codec.encode(text)
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert codec.decode(ids.tolist()) == text.encode()
        if len(ids):
            starts, ends = codec.char_offsets(ids)
            raw, at = text.encode(), 0
            for i, a, b in zip(ids.tolist(), starts, ends, strict=True):
                token = library.decode_single_token_bytes(i)
                inside = [k for k, c in enumerate(text) if len(text[:k].encode()) < at + len(token) and len(text[: k + 1].encode()) > at]
                assert (a, b) == (inside[0], inside[-1] + 1)
                at += len(token)
            assert at == len(raw)


def test_long_texts_are_cut_at_safe_places_only(codec, library):
    rng = random.Random(5)
    text = "".join(rng.choices(["word", " ", "  ", "\n", "x", "é"], k=900_000))
    assert len(text) > 1 << 20
    assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_frames(spark, library):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, ids string").repartition(3)
    out = byte_bpe.encoded(df, ranks_path=PATH, pattern=P.PATTERN, outputs=("ids", "n_tokens", "decoded", "char_starts", "byte_ends"))
    assert [c for c in out.columns] == ["doc_id", "text", "ids", "n_tokens", "decoded", "char_starts", "byte_ends"]
    back = byte_bpe.decoded(out.drop("decoded"), ranks_path=PATH, pattern=P.PATTERN)
    rows = back.collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) and bytes(r.decoded) == (r.text or "").encode()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encoded(empty, ranks_path=PATH, pattern=P.PATTERN).count() == 0


def test_query(spark, sf_dir, library):
    got = {r.doc_id: r for r in QUERIES["op9_byte_bpe"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest())


def test_other_patterns_go_without_the_cache(spark):
    pattern = r"\S+\s+\S+|\s+|\S+"
    texts = ["hello world again", " two  words\n", "", None, "one", "a b c d e"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in byte_bpe.encoded(df, ranks_path=P.path("byte_bpe_50k.tiktoken"), pattern=pattern).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert all(got[i] == library.encode_ordinary(t or "") for i, t in enumerate(texts))
