"""Near-duplicate vectors by product quantisation.

Equal vectors are one representative with a multiplicity. A bounded sample of the representatives, scaled to length 1,
gives coarse centroids; every representative goes to the inverted list of its nearest centroid, and what is left of it
is coded by subspaces, a byte each. A vector probes every list that can hold a vector within the distance that the
least cosine allows: a vector of another list is no nearer to this list's centroid than to its own, so the plane
halfway between the two centroids bounds it. In a probed list the distances to the coded members are a product with what
their codes stand for (the sums of the look-up tables, at a fraction of their cost); those that, less the member's own coding error, stay within the distance are compared by their exact cosine
in double precision. Neither bound loses a pair, so the index finds all links (the tests measure recall).

Lists are cut into blocks of members and blocks of probing vectors by hash, so a crowded list is many groups. A
group returns a row for each vector that has links there: their number and one edge toward the smallest vector that it
is connected to within the group. Pairs are never written out.

Vectors that are null or empty, are zero, or hold a null or non-finite component link with nothing, nor do rows with a
null id (their component is null). Vectors of different lengths link with nothing of another length. Repeated rows
count as vectors of their own; different vectors of one id share their links and component. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import once, written

FOUND = "rep bigint, links bigint, toward bigint"


@dataclass
class Quantiser:
    centroids: np.ndarray  # lists x dim
    books: list[np.ndarray]  # of each subspace: codes x its width
    edges: list[int]  # where subspaces end

    def residual_codes(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and coding errors."""
        rest = x - self.centroids[lists]
        codes, error, at = [], np.zeros(len(x)), 0
        for book, end in zip(self.books, self.edges, strict=True):
            code = nearest(rest[:, at:end], book)
            error += ((rest[:, at:end] - book[code]) ** 2).sum(1)
            codes.append(code.astype(np.uint8))
            at = end
        return np.stack(codes, 1), np.sqrt(error)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """What the codes stand for: residuals, in single precision."""
        return np.concatenate([book.astype(np.float32)[codes[:, m]] for m, book in enumerate(self.books)], axis=1)

    def distances(self, x: np.ndarray, which: int, decoded: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances of the vectors to coded members of a list: the sums of the subspaces' look-up tables,
        made as one product with the decoded members, because so many look-ups cost several times as much."""
        rest = (x - self.centroids[which]).astype(np.float32)
        total = rest @ (-2 * decoded.T)
        total += (rest**2).sum(1)[:, None]
        total += (decoded**2).sum(1)
        return total

    def probes(self, x: np.ndarray, lists: np.ndarray, reach: float) -> list[np.ndarray]:
        """The lists after the vector's own that can hold something within ``reach`` (of a pair, one side probes)."""
        square = (self.centroids**2).sum(1)
        away = square - 2 * x @ self.centroids.T  # squared distance less |x|^2
        apart = np.sqrt(np.maximum(square[:, None] + square - 2 * self.centroids @ self.centroids.T, 1e-30))
        bound = (away - away[np.arange(len(x)), lists][:, None]) / (2 * apart[lists])
        near = (bound <= reach + 1e-6) & (np.arange(len(self.centroids)) > lists[:, None])
        return [np.flatnonzero(row) for row in near]


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centroids = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=len(centroids))
        used = sizes > 0
        centroids[used] = sums[used] / sizes[used, None]
    return centroids


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


def fit(sample: np.ndarray, n_lists: int, subspaces: int = 8, codes: int = 256, seed: int = 3) -> Quantiser:
    centroids = k_means(sample, min(n_lists, len(sample)), 8, seed)
    rest = sample - centroids[nearest(sample, centroids)]
    edges = [int(e) for e in np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1)[1:]]
    books = [k_means(rest[:, a:e], codes, 6, seed) for a, e in zip([0, *edges[:-1]], edges, strict=True)]
    return Quantiser(centroids, books, edges)


def matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Labels:
    """Smallest connected vector of each of some vectors; ``edges`` keeps what joins labels given up to new ones."""

    def __init__(self, ids: np.ndarray):
        self.of, self.edges = ids.copy(), []

    def lower(self, where: np.ndarray, new: np.ndarray) -> bool:
        old = self.of[where]
        less = new < old
        if not less.any():
            return False
        self.edges.append(np.unique(np.stack((old[less], new[less]), 1), axis=0))
        self.of[where[less]] = new[less]
        return True


def linked_in_group(ids: np.ndarray, many: np.ndarray, x: np.ndarray, member: np.ndarray, codes: np.ndarray, error: np.ndarray, which: int, q: Quantiser, least: float, within: bool, step: int = 512) -> tuple[np.ndarray, list]:
    """Number of linked vectors of each row, and the edges toward the smallest. Probing rows meet members; with ``within`` members meet members."""
    reach = np.sqrt(2 - 2 * least)
    bound = ((reach + 1e-4 + error) ** 2).astype(np.float32)
    members, probing = np.flatnonzero(member), np.flatnonzero(~member)
    decoded = q.decoded(codes[members])
    links, labels = np.zeros(len(ids), np.int64), Labels(ids)
    jobs = [(probing[i : i + step], 0) for i in range(0, len(probing), step)]
    if within:
        jobs += [(members[i : i + step], i) for i in range(0, len(members), step)]
    top = np.iinfo(np.int64).max
    for rows, skip in jobs:
        cols = members if not within or not member[rows[0]] else members[skip:]
        close = q.distances(x[rows], which, decoded if cols is members else decoded[skip:]) <= bound[cols]
        if cols is not members or (within and member[rows[0]]):
            close &= np.arange(len(cols)) > np.arange(len(rows))[:, None]  # each pair once, none with itself
        some, has = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
        if not len(some):
            continue
        rows, cols, close = rows[some], cols[has], close[np.ix_(some, has)]
        close &= x[rows] @ x[cols].T >= least
        links[rows] += close @ many[cols]
        links[cols] += many[rows] @ close
        moved = True
        while moved:
            moved = labels.lower(rows, np.where(close, labels.of[cols], top).min(1))
            moved |= labels.lower(cols, np.where(close, labels.of[rows][:, None], top).min(0))
    return links, labels


def valid(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95, sample_rows: int = 16_384, max_lists: int = 1024, block: int = 4096, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. The quantiser is fitted on at most ``sample_rows`` vectors."""
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v"))
    good = rows.where(F.col("vec_id").isNotNull() & valid("v"))
    reps = written(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")), "vectors")
    dims = [r["dim"] for r in reps.select(F.size("v").alias("dim")).distinct().collect()]
    found = spark.createDataFrame([], FOUND)
    for dim in sorted(dims):
        found = found.union(links_of(reps.where(F.size("v") == dim), dim, least, sample_rows, max_lists, block, seed))
    found = written(found, "links")
    own = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("toward").alias("b")))
    known = reps.join(own, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    joined = rows.withColumn("_ok", F.col("vec_id").isNotNull() & valid("v")).join(known, F.col("_ok") & (F.col("v") == F.col("_v")), "left")
    result = joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def links_of(reps: DataFrame, dim: int, least: float, sample_rows: int, max_lists: int, block: int, seed: int) -> DataFrame:
    sc = reps.sparkSession.sparkContext
    n = reps.count()
    sample = reps.orderBy(F.xxhash64(F.lit(seed), "rep")).limit(sample_rows).select("v").collect()
    quantiser = fit(unit(np.array([r["v"] for r in sample], np.float64)), max(1, min(max_lists, int(n**0.5))), seed=seed)
    key = hashlib.sha256(quantiser.centroids.tobytes() + quantiser.books[0].tobytes()).hexdigest()
    sent = sc.broadcast(quantiser)  # max_lists centroids and 256 codes a subspace
    reach = float(np.sqrt(2 - 2 * least))

    @F.arrow_udf("struct<list: int, codes: binary, error: double, probes: array<int>>")
    def place(vectors: pa.Array) -> pa.Array:
        q = once(("pq", key), lambda: sent.value)
        lists_, codes_, errors, probes = [], [], [], []
        for at in range(0, len(vectors), 2048):
            x = unit(matrix(vectors.slice(at, 2048), dim))
            own = nearest(x, q.centroids)
            codes, error = q.residual_codes(x, own)
            lists_ += own.tolist()
            codes_ += [c.tobytes() for c in codes]
            errors += error.tolist()
            probes += [p.tolist() for p in q.probes(x, own, reach)]
        return pa.StructArray.from_arrays([pa.array(lists_, pa.int32()), pa.array(codes_, pa.binary()), pa.array(errors, pa.float64()), pa.array(probes, pa.list_(pa.int32()))], names=["list", "codes", "error", "probes"])

    placed = written(reps.withColumn("p", place("v")).select("rep", "many", "v", "p.*"), "placed")
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # a row for each list
    asked = {r["list"]: r["count"] for r in placed.select(F.explode("probes").alias("list")).groupBy("list").count().collect()}
    blocks = [max(1, -(-sizes.get(i, 0) // block)) for i in range(len(quantiser.centroids))]
    # probing vectors of other lists, and those of the same list that meet its later blocks, in groups of their own
    crowds = [max(1, -(-(asked.get(i, 0) + (sizes.get(i, 0) if blocks[i] > 1 else 0)) // (4 * block))) for i in range(len(blocks))]
    cut = F.array(*[F.struct(F.lit(b).alias("blocks"), F.lit(c).alias("crowds")) for b, c in zip(blocks, crowds, strict=True)])
    h = F.xxhash64("rep")
    dealt = placed.withColumn("cut", F.element_at(cut, F.col("list") + 1)).withColumn("block", F.pmod(h, F.col("cut.blocks")).cast("int"))
    crowd = lambda c: F.pmod(F.xxhash64(h), F.col(c)).cast("int")
    member = dealt.select("list", "block", F.explode(F.sequence(F.lit(0), F.col("cut.crowds") - 1)).alias("crowd"), "rep", "many", "v", "codes", "error", F.lit(True).alias("member"))
    nothing = (F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), F.lit(False).alias("member"))
    others = placed.select("rep", "many", "v", F.explode("probes").alias("list")).withColumn("cut", F.element_at(cut, F.col("list") + 1))
    others = others.select("list", F.explode(F.sequence(F.lit(0), F.col("cut.blocks") - 1)).alias("block"), crowd("cut.crowds").alias("crowd"), "rep", "many", "v", *nothing)
    later = dealt.where("block < cut.blocks - 1").select("list", F.explode(F.sequence(F.col("block") + 1, F.col("cut.blocks") - 1)).alias("block"), crowd("cut.crowds").alias("crowd"), "rep", "many", "v", *nothing)

    def group(table: pa.Table) -> pa.Table:
        q = once(("pq", key), lambda: sent.value)
        ids = table.column("rep").to_numpy()
        is_member = table.column("member").to_numpy(zero_copy_only=False).astype(bool)
        out = {"rep": [], "links": [], "toward": []}
        if is_member.any():
            x = unit(matrix(table.column("v"), dim))
            codes = np.zeros((len(ids), len(q.books)), np.uint8)
            codes[is_member] = np.frombuffer(b"".join(c for c in table.column("codes").to_pylist() if c is not None), np.uint8).reshape(-1, len(q.books))
            error = np.nan_to_num(table.column("error").to_numpy(zero_copy_only=False).astype(np.float64))
            within = table.column("crowd")[0].as_py() == 0
            links, labels = linked_in_group(ids, table.column("many").to_numpy(), x, is_member, codes, error, table.column("list")[0].as_py(), q, least, within)
            has = links > 0
            out = {"rep": ids[has], "links": links[has], "toward": labels.of[has]}
            for e in labels.edges:
                out = {"rep": np.concatenate((out["rep"], e[:, 0])), "links": np.concatenate((out["links"], np.zeros(len(e), np.int64))), "toward": np.concatenate((out["toward"], e[:, 1]))}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return member.unionByName(others).unionByName(later).groupBy("list", "block", "crowd").applyInArrow(group, FOUND)
