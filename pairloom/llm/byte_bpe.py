"""Byte-level BPE encoding and decoding by a rank file.

The ranks become a model of the tokenizers library: each rank's two parts are found once, on the driver, by merging
its bytes with the lower ranks only, and the bytes are spelt with the library's byte-to-character table. Arrow
batches of texts are encoded in the workers; equal pieces of text are given to the library once (``PieceCache``).
Offsets come from the byte lengths of the tokens, carried from bytes to characters. Decoding reverses the table, so
characters that are split over tokens come out whole again.

Nulls are encoded as empty texts: no ids, empty bytes. Equal rows give equal results, an empty table an empty one,
and outputs replace input columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ChunkTable, EachWhole, PieceCache, cut_ids, encoded_pieces, once, read_bytes, small_batches

TYPES = {
    "n_tokens": ("bigint", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "byte_ends": ("array<bigint>", pa.list_(pa.int64())),
    "char_starts": ("array<bigint>", pa.list_(pa.int64())),
    "char_ends": ("array<bigint>", pa.list_(pa.int64())),
    "decoded": ("binary", pa.binary()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def byte_table() -> list[str]:
    """The library's character for each byte: printable Latin-1 stands for itself, the rest from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def parts_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes ``token``: its bytes merged by the ranks below its own."""
    own, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best >= own:
            raise ValueError(f"rank {own} can't be reached by merges of lower ranks")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def as_tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The ranks as a description that the tokenizers library reads."""
    spell = byte_table()
    text = lambda token: "".join(spell[b] for b in token)
    merges = [[text(x) for x in parts_of(token, ranks)] for token in sorted(ranks, key=ranks.get) if len(token) > 1]
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        ]},
        "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {text(t): r for t, r in ranks.items()}, "merges": merges},
    })


class ByteBpe:
    """Encoder and decoder of one worker."""

    def __init__(self, description: str, cached: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        back = {c: b for b, c in enumerate(byte_table())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for spelt, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in spelt)
        self.size_of = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.digits_of = [str(i) for i in range(len(self.bytes_of))]
        self.model, self.spell = self.tokenizer.model, byte_table()
        self.table = ChunkTable(PieceCache(self._encode_new, limit=50_000), "<u4", lead=True, limit=150_000, most=16 << 20, slice_bytes=1 << 20) if cached else EachWhole(self.tokenizer)

    def _encode_new(self, pieces: list[str]) -> list[bytes]:
        return encoded_pieces(pieces, self._encode_word, self._encode_all)

    def _encode_word(self, piece: str) -> bytes:
        """The pattern takes letters and one blank before them as one, so the library's model gets them directly."""
        spelt = piece.replace(" ", self.spell[0x20]) if piece.isascii() else "".join(map(self.spell.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _encode_all(self, text: str, ends: list[int]) -> list[bytes]:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        if len(ends) == 1:
            return cut_ids(ids, [len(ids)])
        if not text.isascii():
            sizes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            sizes = 1 + (sizes > 0x7F).astype(np.int64) + (sizes > 0x7FF) + (sizes > 0xFFFF)
            ends = np.cumsum(sizes)[np.array(ends) - 1]
        return cut_ids(ids, (np.searchsorted(np.cumsum(self.size_of[ids]), ends) + 1).tolist())

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.table.each(pa.array([text], pa.string())))

    def decode(self, ids) -> bytes:
        """The bytes of the ids; decode them as UTF-8 only when all tokens of a character are there."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def char_offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the character in which it starts and the one after that in which it ends.

        Tokens that share a split character all cover it.
        """
        raw = np.frombuffer(self.decode(ids.tolist()), np.uint8)
        lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters begun before each byte
        ends = np.cumsum(self.size_of[ids])
        starts = ends - self.size_of[ids]
        return lead[starts + 1] - 1, lead[ends]

    def outputs(self, ids: np.ndarray, names: tuple[str, ...]) -> tuple:
        listed = ids.tolist()
        found: dict = {"n_tokens": len(listed)}
        if {"decoded", "decoded_sha256"} & {*names}:
            found["decoded"] = self.decode(listed)
        if "decoded_sha256" in names:
            found["decoded_sha256"] = hashlib.sha256(found["decoded"]).hexdigest()
        if "ids_sha256" in names:
            found["ids_sha256"] = hashlib.sha256(" ".join(map(self.digits_of.__getitem__, listed)).encode()).hexdigest()
        if "ids" in names:
            found["ids"] = listed
        if "byte_ends" in names:
            found["byte_ends"] = np.cumsum(self.size_of[ids]).tolist()
        if {"char_starts", "char_ends"} & {*names}:
            a, b = self.char_offsets(ids) if listed else (ids, ids)
            found |= {"char_starts": a.tolist(), "char_ends": b.tolist()}
        return tuple(found[n] for n in names)


def sent(spark, ranks_path: str, pattern: str):
    """The model, broadcast (it has a vocabulary's size), and a key for it.

    Chunks are cached for the public pattern only, of which no match goes on from text into white space.
    """
    from public_tokenizers import PATTERN

    small_batches(spark)
    text = as_tokenizer_json(read_ranks(read_bytes(ranks_path)), pattern)
    return spark.sparkContext.broadcast((text, pattern == PATTERN)), hashlib.sha256(text.encode()).hexdigest()


def encoded(df: DataFrame, text: str | Column = "text", *, ranks_path: str, pattern: str, outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """``df`` with the named outputs (see TYPES) of encoding, and for ``decoded*`` of decoding the ids again."""
    description, key = sent(df.sparkSession, ranks_path, pattern)

    @F.arrow_udf("struct<" + ", ".join(f"{n}: {TYPES[n][0]}" for n in outputs) + ">")
    def run(texts: pa.Array) -> pa.Array:
        codec = once(("byte_bpe", key), lambda: ByteBpe(*description.value))
        if {*outputs} <= {"ids", "n_tokens"}:
            rows = [*codec.table.each(texts)]
            ends = np.cumsum([0, *map(len, rows)])
            made = {"n_tokens": pa.array(np.diff(ends)), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), np.concatenate([np.zeros(0, "<u4"), *rows]).astype(np.int32))}
            return pa.StructArray.from_arrays([made[n] for n in outputs], names=list(outputs))
        rows = [codec.outputs(ids, outputs) for ids in codec.table.each(texts)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], TYPES[n][1]) for i, n in enumerate(outputs)], names=list(outputs))

    return unpacked(df, run(F.col(text) if isinstance(text, str) else text), outputs)


def decoded(df: DataFrame, ids: str = "ids", *, ranks_path: str, pattern: str, output: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its ids stand for; a null list stays null."""
    description, key = sent(df.sparkSession, ranks_path, pattern)

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        codec = once(("byte_bpe", key), lambda: ByteBpe(*description.value))
        return pa.array([None if x.as_py() is None else codec.decode(x.as_py()) for x in lists], pa.binary())

    return df.withColumn(output, run(F.col(ids)))


def unpacked(df: DataFrame, struct: Column, names: tuple[str, ...]) -> DataFrame:
    """``df`` and the struct's fields as columns, which replace those of the same name; the struct is made once."""
    keep = [c for c in df.columns if c not in names]
    made = "_made"
    while made in df.columns:
        made += "_"
    return df.withColumn(made, struct).select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"`{made}`.`{n}`").alias(n) for n in names))
