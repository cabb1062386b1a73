"""Token ids of documents in directly addressable files.

A store is a table of segments. A segment holds the ids of some consecutive documents, cut into 8-bit chunks by level:
level 0 has the low chunk of every id, and a bitmap that tells which ids continue on the next level; level 1 has the
next chunk of those, and so on until none continues. A rank directory holds, for every 512 bits of a bitmap, how many
ones stand before them. So the chunk of any token is found from its position by one rank on each level, and no block
is decoded. Segments are rows with raw binary columns in uncompressed Parquet files, because that reaches any file
system that Spark does.

Documents are encoded where they lie; only packed ids are shuffled, by ranges of doc_id, and each range writes its
segments in order. What stands before a segment in its range is part of the row; what stands before a range is the
table ``parts``, which has one row for each range.

Chunks of text are cached for the preparation that word_bpe_49k.json has; with another tokenizer each text is encoded
as a whole. A null text is empty; every document ends with the end id. A null doc_id stands before all others. Rows with equal
doc_id are all written, in the order of their ids' bytes. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_table
from .shared import ChunkTable, EachWhole, PieceCache, cut_ids, encoded_pieces, once, read_bytes, small_batches, splits_at_blanks

SEGMENT = "part int, seg int, before bigint, doc_ids binary, null_ids binary, doc_ends binary, n_docs int, n_tokens bigint, chunks array<binary>, more array<binary>, ranks array<binary>"
ARROW = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("doc_ends", pa.binary()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("chunks", pa.list_(pa.binary())), ("more", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


# -- the codes


def to_levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories; the last level has no bitmap."""
    chunks, more, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        chunks.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest >> 8
        goes_on = rest > 0
        if not goes_on.any():
            return chunks, more, ranks
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % 64))  # whole blocks of 512 bits
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, 8).sum(1, dtype=np.uint32)
        more.append(bits.tobytes())
        ranks.append((np.cumsum(ones, dtype=np.uint32) - ones).tobytes())
        rest = rest[goes_on]


class Segment:
    """Access to the ids of a segment."""

    def __init__(self, chunks, more, ranks):
        self.chunks = [np.frombuffer(x, np.uint8) for x in chunks]
        self.more = [np.frombuffer(x, np.uint8) for x in more]
        self.ranks = [np.frombuffer(x, np.uint32) for x in ranks]

    def __len__(self) -> int:
        return len(self.chunks[0]) if self.chunks else 0

    def __getitem__(self, i: int) -> int:
        """The id at position ``i``, by one rank on each level."""
        found, shift = int(self.chunks[0][i]), 0
        for level, bits in enumerate(self.more):
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i >> 9
            head = bits[block * 64 : i >> 3]
            i = int(self.ranks[level][block]) + int(np.bitwise_count(head).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
            found |= int(self.chunks[level + 1][i]) << shift
        return found

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        if not self.chunks:
            return np.zeros(0, np.uint32)
        found = self.chunks[-1].astype(np.uint32)
        for level in range(len(self.more) - 1, -1, -1):
            own = self.chunks[level].astype(np.uint32)
            goes_on = np.unpackbits(self.more[level], count=len(own), bitorder="little").astype(bool)
            own[goes_on] |= found << np.uint32(8)
            found = own
        return found


# -- writing


class IdEncoder:
    """One worker's encoder: text -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, description: str, cached: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        self.model, self.spell = self.tokenizer.model, byte_table()
        self.table = ChunkTable(PieceCache(self._new), "<u4", lead=False, most=48 << 20, slice_bytes=8 << 20) if cached else EachWhole(self.tokenizer)

    def _new(self, pieces: list[str]) -> list[bytes]:
        return encoded_pieces(pieces, self._encode_word, self._encode_all)

    def _encode_word(self, piece: str) -> bytes:
        """Letters are one word of the pattern, so the library's model gets them directly, lower-cased and spelt."""
        word = piece.lstrip(" ").lower()
        return array("I", [t.id for t in self.model.tokenize(word if word.isascii() else "".join(map(self.spell.__getitem__, word.encode())))]).tobytes()

    def _encode_all(self, text: str, ends: list[int]) -> list[bytes]:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ids = found.ids
        if len(ends) == 1:
            return cut_ids(ids, [len(ids)])
        starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
        return cut_ids(ids, np.searchsorted(starts, ends).tolist())


def packed_ids(df: DataFrame, model_path: str, end_id: int, bounds: list[int]) -> DataFrame:
    """``df`` (doc_id, text) as part (how many bounds lie below doc_id; 0 for null), doc_id and packed ids with the end id."""
    small_batches(df.sparkSession)
    description = read_bytes(model_path).decode()
    key = hashlib.sha256(description.encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast((description, np.array(bounds, np.int64), splits_at_blanks(description)))  # a vocabulary's size, and a number for each part
    end = np.array([end_id], "<u4")

    @F.arrow_udf("struct<part: int, packed: binary>")
    def run(names: pa.Array, texts: pa.Array) -> pa.Array:
        encoder = once(("token_store", key), lambda: IdEncoder(sent.value[0], sent.value[2]))
        press = zstandard.ZstdCompressor(level=1)
        packed = [pack(np.concatenate((ids, end)), press) for ids in encoder.table.each(texts)]
        parts = np.searchsorted(sent.value[1], names.fill_null(np.iinfo(np.int64).min).to_numpy()).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(parts), pa.array(packed, pa.binary())], names=["part", "packed"])

    return df.select("doc_id", run("doc_id", "text").alias("x")).select("x.part", "doc_id", "x.packed")


def pack(ids: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Two bytes an id where that is enough, compressed; the first byte says which."""
    narrow = not len(ids) or ids.max() < 1 << 16
    return (b"\x02" if narrow else b"\x04") + press.compress(ids.astype("<u2" if narrow else "<u4").tobytes())


def unpack(packed: bytes, press: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(press.decompress(packed[1:]), "<u2" if packed[0] == 2 else "<u4").astype(np.uint32)


def write(df: DataFrame, path: str, *, model_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, segment_tokens: int = 1 << 20) -> str:
    """Writes the store of ``df`` to ``path`` and returns it. A segment ends with the document that fills it."""
    spark = df.sparkSession
    named = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the bounds come from doc_id alone: a range exchange would encode every text a first time to sample its keys
    cuts = named.agg(F.percentile_approx("doc_id", [i / n_parts for i in range(1, n_parts)], 20 * n_parts)).first()[0] if n_parts > 1 else None
    docs = packed_ids(named, model_path, end_id, sorted({*(cuts or [])}))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        part, seg, before, held, names, size = -1, 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            chunks, more, ranks = to_levels(np.concatenate(held))
            ids = np.array([x or 0 for x in names], "<i8").tobytes()
            nulls = np.packbits([x is None for x in names], bitorder="little").tobytes()
            ends = np.cumsum([len(x) for x in held], dtype="<i8").tobytes()
            return pa.RecordBatch.from_pylist([{"part": part, "seg": seg, "before": before, "doc_ids": ids, "null_ids": nulls, "doc_ends": ends, "n_docs": len(names), "n_tokens": size, "chunks": chunks, "more": more, "ranks": ranks}], ARROW)

        for batch in batches:
            for own, name, packed in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("packed"), strict=True):
                if own != part:
                    if held:
                        yield flush()
                    part, seg, before, held, names, size = own, 0, 0, [], [], 0
                ids = unpack(packed.as_py(), press)
                held.append(ids)
                names.append(name)
                size += len(ids)
                if size >= segment_tokens:
                    yield flush()
                    seg, before, held, names, size = seg + 1, before + size, [], [], 0
        if held:
            yield flush()

    ordered = docs.repartition(n_parts, "part").sortWithinPartitions("part", "doc_id", "packed")
    ordered.mapInArrow(segments, SEGMENT).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(f"{path}/segments")
    sizes = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row for each partition
    before, parts = 0, []
    for r in sorted(sizes, key=lambda r: r["part"]):
        parts.append((r["part"], before))
        before += r["n"]
    spark.createDataFrame(parts, "part int, part_start bigint").coalesce(1).write.parquet(f"{path}/parts")
    return path


# -- reading


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, int]]:
    """The segments, and for each partition how many ids stand before it."""
    return spark.read.schema(SEGMENT).parquet(f"{path}/segments"), {r["part"]: r["part_start"] for r in spark.read.parquet(f"{path}/parts").collect()}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers)."""
    segments, part_start = open_store(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                ids = Segment(r["chunks"], r["more"], r["ranks"]).all().astype("<u4").view(np.uint8)
                ends = np.frombuffer(r["doc_ends"], "<i8")
                starts = np.concatenate(([0], ends[:-1]))
                null = np.unpackbits(np.frombuffer(r["null_ids"], np.uint8), count=r["n_docs"], bitorder="little").astype(bool)
                offsets = np.concatenate((starts[:1], ends)) * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(r["doc_ids"], "<i8"), pa.int64(), mask=null), pa.array(starts + r["before"] + part_start[r["part"]]), pa.array(ends - starts),
                     pa.LargeBinaryArray.from_buffers(pa.large_binary(), r["n_docs"], [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(ids)]).cast(pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return segments.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, position) with the id there, without decoding; null outside the document.

    Each wanted token is joined to its document's place, and gathered at its segment.
    """
    segments, _ = open_store(spark, path)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = np.frombuffer(r["doc_ends"], "<i8")
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["doc_ids"], "<i8")), pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["seg"], np.int32)), pa.array(np.concatenate(([0], ends[:-1]))), pa.array(ends)], names=["doc_id", "part", "seg", "a", "b"])

    where = segments.select("part", "seg", "doc_ids", "doc_ends").mapInArrow(places, "doc_id bigint, part int, seg int, a bigint, b bigint")
    found = wanted.select("doc_id", "position").join(where, "doc_id", "left").withColumn("at", F.when((F.col("position") >= 0) & (F.col("a") + F.col("position") < F.col("b")), F.col("a") + F.col("position")))
    asked = found.groupBy("part", "seg", (F.xxhash64("doc_id", "position") % 64).alias("salt")).agg(F.collect_list(F.struct("doc_id", "position", "at")).alias("asked"))

    @F.arrow_udf("array<int>")
    def get(chunks: pa.Array, more: pa.Array, ranks: pa.Array, at: pa.Array) -> pa.Array:
        out = []
        for c, m, k, positions in zip(chunks, more, ranks, at, strict=True):
            if c.as_py() is None:
                out.append([None] * len(positions))
                continue
            segment = Segment(c.as_py(), m.as_py(), k.as_py())
            out.append([None if p is None else segment[p] for p in positions.as_py()])
        return pa.array(out, pa.list_(pa.int32()))

    got = asked.join(segments.select("part", "seg", "chunks", "more", "ranks"), ["part", "seg"], "left").withColumn("ids", get("chunks", "more", "ranks", F.col("asked.at")))
    return got.select(F.explode(F.arrays_zip("asked", "ids")).alias("x")).select("x.asked.doc_id", "x.asked.position", F.col("x.ids").alias("token_id"))
