"""Digests of rows, manifests and label sets."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.udfs import canonical_sha256


def pair_digest(record: Column, candidate: Column, similarity: Column) -> Column:
    """sha256 of the pair's canonical JSON; ids and labels don't count."""
    return canonical_sha256(F.struct(record.alias("record"), candidate.alias("candidate"), similarity.alias("similarity")))


def sql_digest(*columns: Column) -> Column:
    """sha256 of the columns' texts joined by U+001F, nulls as U+0000: a digest that SQL engines agree on."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def manifest_lines(df: DataFrame, key: str = "pair_id", digest: str = "digest") -> DataFrame:
    return df.select(F.concat_ws(" ", F.col(key), F.col(digest)).alias("line"))


def manifest_sha256(lines: DataFrame) -> DataFrame:
    """One row: sha256 of all lines in order, each ended by a line feed. A manifest is a report; it is made in one place."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: F.concat(x, F.lit("\n"))), "")
    return lines.agg(F.sha2(text, 256).alias("fingerprint"), F.count("*").alias("n"))


def chained_digest(df: DataFrame, digest: Column, buckets: int = 4096) -> DataFrame:
    """One row: a fingerprint of any number of rows in any order: digests are sorted and hashed within buckets by their
    first bits, then the buckets' hashes in order."""
    x = df.select(digest.alias("d")).withColumn("b", F.conv(F.substring("d", 1, 8), 16, 10).cast("bigint") % buckets)
    parts = x.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s.h), "\n"), 256).alias("fingerprint"))


def manifest_bytes(lines: DataFrame) -> bytes:
    """A manifest file's bytes: sorted lines, fetched partition by partition."""
    return b"".join(f"{r['line']}\n".encode() for r in lines.orderBy("line").toLocalIterator())


def blake2b_hex(raw: bytes) -> str:
    return hashlib.blake2b(raw, digest_size=32).hexdigest()


def labels_fingerprint(labels: DataFrame, key: str = "pair_id", label: str = "label") -> str:
    """BLAKE2b-256 of the canonical JSON object of labels by key, made as a stream."""
    h, first = hashlib.blake2b(b"{", digest_size=32), True
    for r in labels.select(key, label).orderBy(key).toLocalIterator():
        h.update((b"" if first else b",") + f"{json.dumps(r[0], ensure_ascii=False)}:{json.dumps(r[1], ensure_ascii=False)}".encode())
        first = False
    h.update(b"}")
    return h.hexdigest()


def reconcile(manifest: DataFrame, recomputed: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, state: equal, changed, missing (in the manifest only) or extra."""
    m, r = manifest.select(key, F.col("digest").alias("m")), recomputed.select(key, F.col("digest").alias("r"))
    state = F.when(F.col("r").isNull(), "missing").when(F.col("m").isNull(), "extra").when(F.col("m") == F.col("r"), "equal").otherwise("changed")
    return m.join(r, key, "full").select(key, state.alias("state"))


def unseen(runs: DataFrame, log: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Runs whose fingerprint the log hasn't yet: each corpus is evaluated once."""
    return runs.join(log.select(key).distinct(), key, "left_anti")


def isolated_labels(pairs_path: str, labels_path: str) -> None:
    """Labels are kept outside the folder of the pairs."""
    import posixpath

    pairs, labels = posixpath.normpath(pairs_path), posixpath.normpath(labels_path)
    if (labels + "/").startswith(posixpath.dirname(pairs) + "/"):
        raise ValueError("labels lie beside the pairs")
