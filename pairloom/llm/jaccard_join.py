"""Exact n-gram Jaccard join by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct word shingles. Hash order is the global order of n-grams; it
is cut into fragments, and a set into segments, one a fragment. Sets of like size (a ladder of size classes; a set is also
filed in the class of the largest partner it can have) are cut at the same places, into one fragment more
than two linked sets of the class can differ in, so linked sets agree in a whole segment: they share a key of class, fragment
and segment. Sets that may agree in empty segments only share keys of those.

Keys that several sets have are candidates, tested first by parity sketches: a bit for each bin of hashes, set if the bin has
an odd number; two sketches differ in at most as many bits as the sets in elements, so what they rule out is no link. Pairs are
not written out: a key yields a spanning forest of what is left, and the trees' components are the groups of the exact
join. There the fragments' overlaps are counted one after another by products of incidence matrices and summed per
pair; a group yields the number of links of each set and a spanning forest again. Keys and groups with many sets
are dealt over blocks, bounded in sets and in bytes, and block meets block in tasks of their own. Equal sets are one node
with several documents throughout; a node is a 64-bit hash of the set, and sets with one such hash but another second
one become nodes of their own. Elements are 64-bit hashes of shingles. Nothing is capped and no link is lost.

Crowded keys, nodes and groups stay spread: copies of very frequent sets give their keys once, keys that many sets of a
hash sample have are counted apart by partial sums, and crowded sides of joins are met by broadcast (``looked_up``).

Documents without words, empty or null have an empty set and are linked with nothing. With fewer words than a
shingle has, the whole sequence is one shingle. Rows with equal doc_id count as one node; rows with a null doc_id have
a set but no component. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import unpacked
from .components import components
from .shared import ChunkTable, looked_up, once, small_batches, without_gc, written

#: Odd numbers that mix hashes (fixed values, from published hash functions); as many as a shingle may have words.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], np.uint64)
SPLIT = re.compile("[\x20\t-\r]+")
#: Bits of a key that are a hash; those above are its size class.
CLASS_AT = 44
KEY_BITS = np.uint64((1 << CLASS_AT) - 1)
FOUND = "rep bigint, links bigint, toward bigint"
ARROW_FOUND = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("toward", pa.int64())])


# -- sets


class WordHashes:
    """Chunk of text -> the 64-bit hashes of its words, one after another."""

    def join(self, text: str) -> bytes:
        return b"".join([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")).to_bytes(8, "little") for w in SPLIT.split(text) if w])

    def join_each(self, texts: list[str]) -> list[bytes]:
        return [*map(self.join, texts)]


def finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX[5]
    x = (x ^ (x >> np.uint64(29))) * MIX[6]
    return x ^ (x >> np.uint64(32))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles."""
    n = len(words)
    if not n:
        return words
    if n < k:
        return finished((words * MIX[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = words[: n - k + 1] * MIX[0]
    for i in range(1, k):
        total = total + words[i : n - k + 1 + i] * MIX[i]
    return np.unique(finished(total))


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    table = once("jaccard words", lambda: ChunkTable(WordHashes(), "<u8", lead=False, limit=100_000, most=8 << 20))
    for words in table.each(pc.ascii_lower(texts.cast(pa.large_string()))):
        yield shingle_set(words, k)


class Rule:
    """Linked: 100 * intersection >= percent * union. ``apart``: in how many elements two linked sets may differ."""

    def __init__(self, percent: int, ratio: float = 1.5):
        self.percent, bounds = percent, [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * ratio)))
        self.bounds = np.array(bounds, np.int64)

    def apart(self, a, b):
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def class_of(self, size: int) -> int:
        return int(np.searchsorted(self.bounds, size, "right")) - 1

    def keys(self, own: np.ndarray) -> np.ndarray:
        """The set's keys in its own class and that of its largest partner."""
        n, out = len(own), []
        if not n:
            return np.zeros(0, np.int64)
        largest = n * 100 // self.percent
        for c in range(self.class_of(n), self.class_of(largest) + 1):
            top = int(self.bounds[c + 1]) - 1
            k = int(self.apart(top, top)) + 1
            fragment = ((own >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1])))
            place, above = np.uint64(c * 0x1000003 + 1), np.uint64(c << CLASS_AT)
            out.append(finished(np.bitwise_xor.reduceat(finished(own + MIX[3]), starts) + fragment[starts] * MIX[1] + place) & KEY_BITS | above)
            if k - len(starts) >= k - self.apart(n, min(top, largest)):  # a partner may agree with it in empty segments only
                empty = np.setdiff1d(np.arange(k, dtype=np.uint64), fragment[starts])
                out.append(finished(empty * MIX[4] + place) & KEY_BITS | above)
        return np.concatenate(out).astype(np.int64)

    def sets_at_once(self, key, most: int, room: int):
        """How many sets of a key's size class have sketches of ``room`` bytes in all, ``most`` at most (a column)."""
        least = [min(most, max(16, room * 8 // max(64, 2 * int(top)))) for top in self.bounds[1:]]
        return F.element_at(F.array(*map(F.lit, least)), F.shiftright(key, CLASS_AT).cast("int") + 1)


def sketch(own: np.ndarray) -> bytes:
    """Parities of the bins of the set's elements; at least one bin for each, a power of two in number."""
    bins = max(64, 1 << (len(own) - 1).bit_length())
    at = (finished(own ^ MIX[2]) & np.uint64(bins - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bins).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(raw: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all folded to the length of the shortest."""
    least = min(map(len, raw))
    rows = np.empty((len(raw), least // 8), np.uint64)
    for i, x in enumerate(raw):
        words = np.frombuffer(x, np.uint64)
        while len(words) * 8 > least:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        rows[i] = words
    return rows


# -- groups of rows in sorted partitions


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from partitions that are sorted by it; runs of many small keys come as they are read."""
    held: list[pa.RecordBatch] = []

    def last_of(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        change[0] = bool(held) and last_of(held[-1]) != tuple(batch.column(k)[0].as_py() for k in keys)
        at = 0
        for cut in np.flatnonzero(change).tolist():
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Joins rows of a group; ``edges`` is a spanning forest with the smaller id second."""

    def __init__(self, ids: np.ndarray):
        self.root, self.edges = ids.copy(), []

    def join(self, i: int, others: np.ndarray) -> None:
        classes = np.unique(self.root[np.append(others, i)])
        if len(classes) > 1:
            self.edges += [(int(c), int(classes[0])) for c in classes[1:]]
            self.root[np.isin(self.root, classes[1:])] = classes[0]


def as_found(ids, links, edges) -> pa.RecordBatch:
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids, pairs[:, 0])), pa.int64()), pa.array(np.concatenate((links, np.zeros(len(pairs), np.int64))), pa.int64()), pa.array(np.concatenate((ids, pairs[:, 1])), pa.int64())], schema=ARROW_FOUND)


def possible(ids: np.ndarray, sizes: np.ndarray, raw: list[bytes], sides: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of a key that sizes and sketches don't rule out; ``sides`` 0 and 1 meet, 2 meets all."""
    rows, forest = folded(raw), Forest(ids)
    for i in range(len(ids) - 1):
        n, others = sizes[i], sizes[i + 1 :]
        ok = (np.minimum(n, others) * 100 >= rule.percent * np.maximum(n, others)) & (ids[i + 1 :] != ids[i])
        if sides[i] != 2:
            ok &= sides[i + 1 :] != sides[i]
        ok = np.flatnonzero(ok)
        if len(ok):
            differ = np.bitwise_count(rows[i] ^ rows[i + 1 + ok]).sum(1, dtype=np.int64)
            ok = ok[differ <= rule.apart(n, others[ok])]
            if len(ok):
                forest.join(i, i + 1 + ok)
    return forest.edges


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the left with the right sets: partial counts by fragment, summed."""
    total = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for rows in (left, right):
        own = [sets[i] for i in rows]
        sides.append((np.concatenate(own) if own else np.zeros(0, np.uint64), np.repeat(np.arange(len(own)), [len(x) for x in own])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    place = []
    for hashes, rows in sides:
        at = np.searchsorted(shared, hashes)
        at[at == len(shared)] = 0
        keep = shared[at] == hashes if len(shared) else np.zeros(len(hashes), bool)
        order = np.argsort(at[keep], kind="stable")
        place.append((at[keep][order], rows[keep][order]))
    for start in range(0, len(shared), width):
        matrices = []
        for (at, rows), n in zip(place, (len(left), len(right)), strict=True):
            a, b = np.searchsorted(at, (start, start + width))
            m = np.zeros((n, min(width, len(shared) - start)), np.float32)
            m[rows[a:b], at[a:b] - start] = 1
            matrices.append(m)
        total += matrices[0] @ matrices[1].T
    return total.astype(np.int64)


def linked(ids: np.ndarray, many: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, rule: Rule) -> tuple[np.ndarray, list]:
    """Number of linked documents of each row, and a spanning forest of the links."""
    forest, links = Forest(ids), np.zeros(len(ids), np.int64)
    all_pairs = (sides == 2).all()
    left = np.arange(len(ids)) if all_pairs else np.flatnonzero(sides == 0)
    right = left if all_pairs else np.flatnonzero(sides == 1)
    sizes = np.array([len(s) for s in sets], np.int64)
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        common = overlaps(sets, rows, right)
        union = sizes[rows][:, None] + sizes[right] - common
        link = (100 * common >= rule.percent * union) & (ids[rows][:, None] != ids[right])
        links[rows] += link @ many[right]
        if not all_pairs:
            links[right] += many[rows] @ link
        for i, row in zip(rows.tolist(), link, strict=True):
            others = right[row]
            if len(others):
                forest.join(i, others)
    return links, forest.edges


# -- the join


def in_blocks(df: DataFrame, blocks: Column) -> DataFrame:
    """Rows dealt over tasks (i, j) in which two of a group's ``blocks`` meet, with ``side`` 0, 1, or 2 where the block meets itself."""
    rows = df.withColumn("_n", blocks.cast("int")).withColumn("_b", F.pmod(F.xxhash64("rep"), F.col("_n")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = F.when(F.col("_b") == F.col("_o"), F.lit(2)).when(F.col("_b") < F.col("_o"), F.lit(0)).otherwise(F.lit(1))
    return rows.withColumns({"i": F.least("_b", "_o"), "j": F.greatest("_b", "_o"), "side": side}).drop("_n", "_b", "_o")


def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def two_hashes(own: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def with_sets(df: DataFrame, *, text: str, k: int, rule: Rule, outputs: tuple[str, ...]) -> DataFrame:
    """``df`` with n_shingles and, as asked for, node and check (64-bit hashes of the set), keys, sketch and elements."""
    types = {"n_shingles": ("bigint", pa.int64()), "node": ("bigint", pa.int64()), "check": ("bigint", pa.int64()), "keys": ("array<bigint>", pa.list_(pa.int64())), "sketch": ("binary", pa.binary()), "elements": ("binary", pa.binary())}
    make = {"n_shingles": len, "keys": rule.keys, "sketch": sketch, "elements": lambda s: s.tobytes()}

    @F.arrow_udf("struct<" + ", ".join(f"{n}: {types[n][0]}" for n in outputs) + ">")
    def run(texts: pa.Array) -> pa.Array:
        columns: dict[str, list] = {n: [] for n in outputs}
        for own in sets_of(texts, k):
            if "node" in columns:
                for n, x in zip(("node", "check"), two_hashes(own), strict=True):
                    if n in columns:
                        columns[n].append(x)
            for n in columns:
                if n in make:
                    columns[n].append(make[n](own))
        return pa.StructArray.from_arrays([pa.array(columns[n], types[n][1]) for n in outputs], names=list(outputs))

    return unpacked(df, run(F.col(text)), outputs)


def told_apart(df: DataFrame, shared: list[int]) -> DataFrame:
    """Nodes whose hash several sets share get another from both hashes; two sets in 2**64 have one, so there are few."""
    return df.withColumn("node", F.when(F.col("node").isin(shared), F.xxhash64("node", "check")).otherwise(F.col("node"))) if shared else df


def crowded_keys(exploded: DataFrame, every: int = 64, share: int = 100) -> DataFrame:
    """Keys that more than a ``share``-th of the sets of a hash sample have; their number is at most ``share`` times a set's keys.

    Only how keys are counted depends on them, not what is found.
    """
    sample = exploded.where(F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(every)) == 0)
    sets = sample.select("rep").distinct().count()
    counts = sample.groupBy(F.col("key").alias("_hot")).agg(F.count_distinct("rep").alias("_sets"))
    return counts.where(F.col("_sets") > max(8, sets / share)).select("_hot")


def join(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90, key_block: int = 8192, group_block: int = 1024, block_bytes: int = 16 << 20, file_keys: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and n_links for every row.

    ``file_keys`` writes the keys beside the sets' sizes and sketches; without it they are made from the texts again,
    which takes less disk and more time. Blocks hold ``key_block`` sketches or ``group_block`` sets, or fewer that have
    about ``block_bytes`` bytes.
    """
    small_batches(df.sparkSession)
    rule = Rule(percent)
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    own = ("n_shingles", "node", "check", "sketch") + (("keys",) if file_keys else ())
    filed = written(with_sets(docs, text="text", k=k, rule=rule, outputs=own).drop("text"), "sets")
    shared = [r["node"] for r in filed.where("n_shingles > 0").groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a < b").collect()]
    filed = told_apart(filed, shared)
    counted = filed.where("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = written(counted.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many"), F.min("n_shingles").alias("size")), "nodes")
    n_docs = nodes.agg(F.sum("many")).first()[0] or 0
    frequent = F.broadcast(nodes.where(F.col("many") * 1000 > n_docs).select(F.col("node").alias("_often"), F.col("rep").alias("_first")))  # 1000 at most

    keyed = filed if file_keys else told_apart(with_sets(docs, text="text", k=k, rule=rule, outputs=("node", "check", "keys")), shared)
    once_each = keyed.where("doc_id IS NOT NULL").join(frequent, F.col("node") == F.col("_often"), "left").where("_often IS NULL OR doc_id = _first")
    exploded = once_each.select(F.explode("keys").alias("key"), F.col("node").alias("rep"))
    hot = F.broadcast(written(crowded_keys(exploded), "crowded"))
    whole = Window.partitionBy("key")
    marked = exploded.join(hot, F.col("key") == F.col("_hot"), "left")
    several = marked.where("_hot IS NULL").drop("_hot").withColumns({"_least": F.min("rep").over(whole), "_most": F.max("rep").over(whole)}).where("_least < _most").select("key", "rep").distinct()
    several = several.withColumn("count", F.count("*").over(whole))
    crowds = marked.where("_hot IS NOT NULL").select("key", "rep").distinct()
    crowds = crowds.join(F.broadcast(crowds.groupBy(F.col("key").alias("_hot")).agg(F.count("*").alias("count")).where("count > 1")), F.col("key") == F.col("_hot")).drop("_hot")
    sketches = counted.groupBy(F.col("node").alias("rep")).agg(F.min(F.struct(F.col("n_shingles").alias("size"), "sketch")).alias("x")).select("rep", "x.*")
    at_once = rule.sets_at_once(F.col("key"), key_block, block_bytes)
    candidates = in_blocks(several.unionByName(crowds), F.ceil(F.col("count") / at_once)).drop("count").join(sketches, "rep")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "i", "j"]):
            if t.num_rows > 1:
                with without_gc():
                    edges = possible(t.column("rep").to_numpy(), t.column("size").to_numpy(), t.column("sketch").to_pylist(), t.column("side").to_numpy(), rule)
                if edges:
                    yield as_found(np.zeros(0, np.int64), np.zeros(0, np.int64), edges)

    trees = grouped(candidates, ["key", "i", "j"]).mapInArrow(sift, FOUND)
    groups = components(trees.select(F.col("rep").alias("a"), F.col("toward").alias("b")))
    groups = groups.select(F.col("node").alias("_node"), F.col("component").alias("group")).join(nodes, F.col("node") == F.col("_node")).drop("node")
    totals = groups.groupBy(F.col("group").alias("_group")).agg(F.count("*").alias("count"), F.sum("size").alias("sum"))
    blocks = F.greatest(F.ceil(F.col("count") / group_block), F.ceil(F.col("sum") * 8 / block_bytes))
    placed = looked_up(groups, totals.withColumn("blocks", blocks).drop("sum"), "group", "_group", weight="count", total=groups.count()).select("group", "blocks", "many", "rep", "_node")
    texts = placed.join(docs, F.col("rep") == F.col("doc_id")).drop("doc_id", "rep")
    texts = told_apart(with_sets(texts, text="text", k=k, rule=rule, outputs=("node", "check", "elements")).drop("text"), shared).where("node = _node").drop("_node", "check").withColumnRenamed("node", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["group", "i", "j"]):
            ids, first = np.unique(t.column("rep").to_numpy(), return_index=True)  # repeated rows have one id
            t = t.take(pa.array(first))
            sets = [np.frombuffer(x, np.uint64) for x in t.column("elements").to_pylist()]
            with without_gc():
                links, edges = linked(ids, t.column("many").to_numpy(), sets, t.column("side").to_numpy(), rule)
            has = links > 0
            if has.any():
                yield as_found(ids[has], links[has], edges)

    found = written(grouped(in_blocks(texts, F.col("blocks")).drop("blocks"), ["group", "i", "j"]).mapInArrow(compare, FOUND), "links")
    parts = components(found.select(F.col("rep").alias("a"), F.col("toward").alias("b"))).select(F.col("node").alias("_node"), F.col("component").alias("_part"))
    links = found.groupBy(F.col("rep").alias("_rep")).agg(F.sum("links").alias("links"))
    known = nodes.join(links, F.col("node") == F.col("_rep"), "left").join(parts, F.col("node") == F.col("_node"), "left").withColumn("_part", F.coalesce("_part", "node"))
    known = written(known.select("node", "rep", "many", "links", "_part"), "known")
    least = known.groupBy(F.col("_part").alias("_of")).agg(F.min("rep").alias("_component"), F.count("*").alias("_nodes"))
    known = looked_up(known, least, "_part", "_of", weight="_nodes", total=known.count()).select(F.col("node").alias("_known"), "many", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("_links"), "_component")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node"))
    out = looked_up(filed.select("doc_id", "n_shingles", own.alias("_own")), known, "_own", "_known", weight="many", total=n_docs, how="left")
    return out.select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"))


def kept(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component, that of the smallest doc_id; rows with a null doc_id all stay, repeated rows once."""
    left = join(df, doc_id=doc_id, text=text, **options).where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    named = df.join(left, F.col(doc_id) == F.col("_id"), "left_semi").dropDuplicates([doc_id, text])
    return named.union(df.where(F.col(doc_id).isNull())).select(*df.columns)
