"""What several of these operators need: shared folders, worker caches and vocabulary files."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import re
import threading
import time
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode's White_Space code points, as the body of a character class (fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as a set.
SPACES = frozenset(re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))))
#: Latin letters up to U+024F, as the body of a character class (fixed values). U+0130 is not one of them: its lower case
#: ends in a mark, which patterns split off and join to marks that follow.
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
#: A run without white space, with the white space before it. Latin letters that begin a run are cut off if an ASCII
#: character that is no letter follows: that can't combine with them, and every pattern used here ends a token there.
PIECE = re.compile(f"[{WHITE}]*(?:[{LATIN}]+(?=[!-@\\[-`{{-\x7f{WHITE}]|\\Z)|[^{WHITE}]+)|[{WHITE}]+")
#: A piece that is one word of Latin letters, after one blank or none.
WORD_PIECE = re.compile(f" ?[{LATIN}]+")
EDGE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
#: Words of the contracts on documents: runs without ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: The Python object that a worker process has built last, by key, and when it was asked for.
BUILT: dict = {}
USED = [0.0]
IDLE_S = 15
#: Parameters of the C library's allocator and the values used for them (the numbers are fixed by it): one arena, blocks of
#: a MB and more apart, so that they go back at once, and free memory at the end given back.
ALLOCATOR = ((-8, 1), (-3, 1 << 20), (-1, 1 << 20))


def once(key, build):
    """What ``build()`` returned at this worker's first call with ``key``, as long as no other key was asked for.

    What was built for another key is let go first, so a worker that serves one stage after another holds one model.
    Workers stay when their stage is over; one that isn't asked for some seconds lets its object and caches go as well.
    """
    if key not in BUILT:
        if not USED[0]:
            with contextlib.suppress(OSError, AttributeError):
                for name, value in ALLOCATOR:
                    ctypes.CDLL(None).mallopt(name, value)
            pa.set_memory_pool(pa.system_memory_pool())  # its free memory can be given back
            threading.Thread(target=_let_go, daemon=True).start()
        BUILT.clear()
        give_back()
        BUILT[key] = build()
    USED[0] = time.monotonic()
    return BUILT[key]


def _let_go() -> None:
    while True:
        time.sleep(IDLE_S / 3)
        if BUILT and time.monotonic() - USED[0] > IDLE_S:
            BUILT.clear()
            give_back()


def give_back() -> None:
    """Returns the free memory of this process to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def executors_give_back(spark: SparkSession) -> None:
    """Has the executors' Java machines collect their garbage now, a task for each core, so that heap and buffers go back.

    A heap grows to its limit in a heavy stage and stays so large, beside the Python workers of the stages after it. A
    full collection shrinks it to what is in use. Where explicit collections are disabled nothing happens.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts are kept small, unless the session says otherwise: a worker holds several of them at once."""
    for name, usual, own in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b")):
        if spark.conf.get(name) == usual:
            spark.conf.set(name, own)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; it is read on the driver and sent to the workers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def splits_at_blanks(description: str) -> bool:
    """Whether a tokenizer prepares texts as that of word_bpe_49k.json does, whose words never cross white space.

    Caches of chunks between blanks are exact for that preparation; other ones go without.
    """
    own, known = json.loads(description), json.loads(read_bytes(vocabulary("word_bpe_49k.json")))
    return all(own.get(part) == known[part] for part in ("normalizer", "pre_tokenizer", "added_tokens"))


class EachWhole:
    """Stands for a ``ChunkTable`` where nothing is known of the pattern: every text goes to the library as it is."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for text in texts:
            yield np.array(self.tokenizer.encode(text.as_py() or "", add_special_tokens=False).ids, "<u4")


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session has none, one is set on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file:///tmp/pairloom-checkpoints"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Lists of the paths that ``written`` makes, one for each open ``tables_made``.
MADE: list[list[str]] = []


@contextlib.contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths of the tables that ``written`` makes inside."""
    own: list[str] = []
    MADE.append(own)
    try:
        yield own
    finally:
        MADE.remove(own)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    Row groups are small, because each open file holds one in memory.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.options(**{"parquet.block.size": 16 << 20, **options}).parquet(path)
    for own in MADE:
        own.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def looked_up(rows: DataFrame, table: DataFrame, key: str, of: str, *, weight: str, total: int, how: str = "inner", shares: int = 1000) -> DataFrame:
    """``rows`` joined on ``key`` with ``table``, which has each value of ``of`` once and in ``weight`` how many rows have it.

    Keys with more than a ``shares``-th of the ``total`` rows are at most ``shares`` in number, so those are broadcast,
    and no task gets a crowded key; the others are joined by shuffle. Columns of the two differ in name.
    """
    heavy = F.col(weight) * shares > total
    marked = rows.join(F.broadcast(table.where(heavy)), F.col(key) == F.col(of), "left")
    rest = marked.where(F.col(of).isNull()).select(*rows.columns).join(table.where(~heavy), F.col(key) == F.col(of), how)
    return marked.where(F.col(of).isNotNull()).unionByName(rest)


@contextlib.contextmanager
def without_gc():
    """The caches are many small objects without cycles; searching them for cycles again and again costs more than the work."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def blocks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in blocks of about ``size`` code points, each but the first starting with white space after a non-space."""
    if len(text) <= size:
        yield text
        return
    at = 0
    while at < len(text):
        cut = EDGE.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class PieceCache:
    """piece -> encoded bytes.

    No pattern of the vocabularies used here reaches over the end of a piece, so a text's encoding is that of its
    pieces, one after another. ``encode`` gets the pieces not seen yet. The cache has two generations
    of ``limit`` entries at most, so that its memory is bounded and common pieces stay.
    """

    def __init__(self, encode, limit: int = 250_000, longest: int = 48):
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.encode, self.limit, self.longest = encode, limit, longest

    def join(self, text: str) -> bytes:
        out = []
        for block in blocks(text):
            pieces = PIECE.findall(block)
            new = set(pieces).difference(self.known)
            if new:
                if len(self.known) + len(new) > self.limit:
                    self.known, self.before, new = {}, self.known, set(pieces)
                before = self.before
                self.known.update([(x, before[x]) for x in new if x in before])
                fresh = [x for x in new if x not in before]
                self.known.update(zip(fresh, self.encode(fresh), strict=True))
            out.append(b"".join(map(self.known.__getitem__, pieces)))
            for x in new:
                if len(x) > self.longest:
                    del self.known[x]
        return out[0] if len(out) == 1 else b"".join(out)

    def join_each(self, texts: list[str]) -> list[bytes]:
        """As ``join`` of each of many short texts."""
        found = [PIECE.findall(x) for x in texts]
        pieces = set().union(*found)
        if len(self.known) + len(pieces) > self.limit:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = pieces.difference(known)
        known.update([(x, before[x]) for x in new if x in before])
        fresh = [x for x in new if x not in before]
        known.update(zip(fresh, self.encode(fresh), strict=True))
        get = known.__getitem__
        out = [get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for x in found]
        for x in new:
            if len(x) > self.longest:
                del known[x]
        return out


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The items of each piece of the pool, one piece after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    small = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    where = np.repeat((starts - (ends - sizes)).astype(small), sizes)
    where += np.arange(total, dtype=small)
    return pool[where]


class Known:
    """A generation of the cache: keys as an Arrow array, and where in a pool the items of each are."""

    def __init__(self, dtype: np.dtype):
        self.keys = pa.array([], pa.large_string())
        self.starts, self.sizes, self.pool, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, dtype), 0

    def places(self, keys: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy()

    def add(self, keys: pa.Array, sizes: np.ndarray, items: np.ndarray) -> None:
        if self.used + len(items) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.empty(self.used + 2 * len(items), self.pool.dtype)))
        self.pool[self.used : self.used + len(items)] = items
        self.keys = pa.concat_arrays([self.keys, keys])
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.used += len(items)


class ChunkTable:
    """Encodings of Arrow arrays of texts, by what stands between their blanks.

    The texts are split at each blank, and the chunks dictionary-encoded and looked up by Arrow, so that Python sees
    a chunk only when it is new; the rows are put together again by index arithmetic. ``pieces`` encodes new chunks.
    With ``lead`` a chunk takes the blank before it with it, else the blanks stand for ``blank``. The cache has two
    generations, each of ``limit`` chunks and ``most`` bytes at most, so that common chunks stay.
    """

    def __init__(self, pieces, dtype: str, *, lead: bool, blank: bytes = b"", limit: int = 600_000, most: int = 24 << 20, slice_bytes: int = 2 << 20):
        self.pieces, self.dtype, self.lead, self.blank, self.limit, self.most, self.slice_bytes = pieces, np.dtype(dtype), lead, blank, limit, most, slice_bytes
        self.known, self.before = Known(self.dtype), Known(self.dtype)

    def _find(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool of ``known`` the items of the chunks start, and how many they are."""
        if len(self.known.keys) + len(chunks) > self.limit or self.known.keys.nbytes + self.known.used * self.dtype.itemsize > self.most:
            self.known, self.before = Known(self.dtype), self.known
        known, before = self.known, self.before
        at = known.places(chunks).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = chunks.take(pa.array(new))
            old = before.places(fresh)
            has = old >= 0
            first = len(known.keys)
            if has.any():
                known.add(fresh.filter(pa.array(has)), before.sizes[old[has]], gathered(before.pool, before.starts[old[has]], before.sizes[old[has]]))
            at[new[has]] = first + np.arange(int(has.sum()))
            rest = fresh.filter(pa.array(~has))
            if len(rest):
                first, blank = len(known.keys), self.blank
                found = self.pieces.join_each(rest.to_pylist())
                if blank:
                    found = [x + blank for x in found]
                known.add(rest, np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize, np.frombuffer(b"".join(found), self.dtype))
                at[new[~has]] = first + np.arange(len(rest))
        return known.starts[at], known.sizes[at]

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        rows = pc.split_pattern(texts, " ")
        ends = rows.offsets.to_numpy()[1:] - rows.offsets[0].as_py()
        coded = rows.flatten().dictionary_encode()
        at, chunks = coded.indices.to_numpy(), coded.dictionary
        firsts = np.concatenate(([0], ends[:-1]))
        if self.lead:
            used = np.unique(at[firsts])
            n = len(chunks)
            spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), chunks, pa.scalar(" ", pa.large_string()))
            chunks = pa.concat_arrays([spaced, chunks.take(pa.array(used))])
            at = at.copy()
            at[firsts] = n + np.searchsorted(used, at[firsts])
            again = chunks.dictionary_encode()  # a first chunk may begin with a blank of its own
            chunks, at = again.dictionary, again.indices.to_numpy()[at]
        starts, sizes = self._find(chunks)
        own = sizes[at]
        items = gathered(self.known.pool, starts[at], own)
        cuts, drop = np.cumsum(own)[ends - 1], len(self.blank) // self.dtype.itemsize
        return [items[a : b - drop] for a, b in zip(np.concatenate(([0], cuts[:-1])), cuts, strict=True)]

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The items of each text; none for null."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, f" [{WHITE}]| $").to_numpy(zero_copy_only=False) if self.lead else np.zeros(len(texts), bool)
        sizes = pc.binary_length(texts).to_numpy()
        odd |= sizes > 4 << 20  # these go by blocks
        at, rows = 0, None
        while at < len(texts):
            if odd[at]:
                yield np.frombuffer(self.pieces.join(texts[at].as_py()), self.dtype)
                at += 1
                continue
            end, size = at, 0
            while end < len(texts) and not odd[end] and (size == 0 or size + sizes[end] <= self.slice_bytes):
                size += int(sizes[end])
                end += 1
            with without_gc():
                rows = self._slice(texts.slice(at, end - at))
            yield from rows
            at = end
        del rows
        give_back()


def encoded_pieces(pieces: list[str], encode_word, encode_all, group: int = 512) -> list[bytes]:
    """The ids' bytes of each piece: single words from ``encode_word(piece)``, the rest from ``encode_all(text, ends)``.

    Pieces that begin with white space go there as one text, with the code points at which they end, because a call
    for each would cost more than the encoding.
    """
    found = {p: encode_word(p) for p in pieces if WORD_PIECE.fullmatch(p)}
    joint = [p for p in pieces if p not in found and p[0] in SPACES and p[-1] not in SPACES]
    for at in range(0, len(joint), group):
        own = joint[at : at + group]
        ends, end = [], 0
        for p in own:
            end += len(p)
            ends.append(end)
        found.update(zip(own, encode_all("".join(own), ends), strict=True))
    return [found[p] if p in found else encode_all(p, [len(p)])[0] for p in pieces]


def cut_ids(ids: list[int], cuts) -> list[bytes]:
    """The bytes of ``ids`` as unsigned 32-bit integers, cut after as many ids as ``cuts`` tells."""
    raw, before, out = array("I", ids).tobytes(), 0, []
    for cut in cuts:
        out.append(raw[4 * before : 4 * cut])
        before = cut
    return out
