"""Bounded samples of labelled rows, and the hash split of labelled rows that the contracts name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

SALTS = 32


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % modulus


def labelled_windows(df: DataFrame, *, label: str, text: str, per_class: int, windows: int, chars: int, seed: int = 11) -> list[Row]:
    """(label, pieces): of at most ``per_class`` rows of each label, chosen by hash, ``windows`` pieces of ``chars`` characters.

    The pieces are drawn over the whole text, one from each of as many equal parts, at a place that a hash tells; a text
    of at most ``windows * chars`` characters is one piece. Rows are chosen within (label, salt), so that a label that
    most rows have is not gathered in one task; the driver gets ``per_class + SALTS`` rows a label at most.
    """
    share = -(-per_class // SALTS)
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "text")).withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(SALTS)))
    part = (F.char_length("text") / windows).alias("_part")
    at = lambda i: ((i + F.pmod(F.xxhash64("_h", i), F.lit(1024)) / 1024) * F.char_length("text") / windows).cast("int") + 1
    drawn = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring("text", at(i), F.lit(chars)))
    rows = rows.withColumn("pieces", F.when(part <= chars, F.array("text")).otherwise(drawn))
    rank = F.row_number().over(Window.partitionBy("label", "_salt").orderBy("_h"))
    picked = rows.select("label", "pieces", "_h", "_salt").withColumn("_rank", rank).where(F.col("_rank") <= share).select("label", "pieces", "_h").collect()
    return sorted(picked, key=lambda r: (str(r["label"]), r["_h"]))


def labelled_texts(docs: DataFrame, labels: DataFrame, *, label: str, key: str = "doc_id", text: str = "text", per_class: int, max_bytes: int, seed: int = 11) -> list[Row]:
    """(label, text) for labels in a table of their own (``key``, ``label`` 0 or 1): whole texts.

    This is the bounded sample that classifiers are fitted on: of each label at most ``per_class`` rows, chosen by hash
    from the labels alone, so that of the documents only the chosen ones move, and of those as many as have
    ``max_bytes`` in all, in each of ``SALTS`` parts (a text longer than a part's share is not learned from, never cut).
    Of several labels of one id the smallest counts, and of several texts; null ids have no label.
    """
    share, room = -(-per_class // SALTS), max_bytes // SALTS
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).withColumn("_h", F.xxhash64(F.lit(seed), "_key"))
    rows = rows.withColumn("_salt", F.pmod("_h", F.lit(SALTS))).groupBy("_key", "_h", "_salt").agg(F.min("label").alias("label"))
    rank = F.row_number().over(Window.partitionBy("label", "_salt").orderBy(F.xxhash64("_h"), "_key"))
    picked = rows.withColumn("_rank", rank).where(F.col("_rank") <= share).select("_key", "label", "_h", "_salt")  # per_class + SALTS rows a label at most
    found = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(picked), "_key")
    one = found.groupBy("_key").agg(F.min(F.struct("label", "text", "_h", "_salt")).alias("x")).select("x.*")
    total = F.sum(F.octet_length("text")).over(Window.partitionBy("label", "_salt").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0))
    got = one.withColumn("_total", total).where(F.col("_total") <= room).select("label", "text", "_h").collect()
    return sorted(got, key=lambda r: (r["label"], r["_h"]))


def label_counts(labels: DataFrame, label: str) -> dict[int, int]:
    return {int(r["label"]): r["count"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("label")).count().collect()}
