"""Assembling corpora: removal of what is known or contaminated, splits, quotas, samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.functions import udfs


def first_seen(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return first_seen(df, key, [o.desc() for o in order])


def occupied(df: DataFrame, layers: dict[str, DataFrame], key: str) -> DataFrame:
    """``df`` with ``removed_by``: the first layer that has its key, null if none."""
    out, names = df, []
    for i, (name, layer) in enumerate(layers.items()):
        out = out.join(layer.select(F.col(key)).distinct().withColumn(f"_l{i}", F.lit(name)), key, "left")
        names.append(f"_l{i}")
    return out.withColumn("removed_by", F.coalesce(*names)).drop(*names)


def overlap_flags(df: DataFrame, surface: DataFrame, hashes: dict[str, Column], surface_hash: Column) -> DataFrame:
    """id and the sorted names of its hashes that the surface has."""
    own = df.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), h.alias("h")) for n, h in hashes.items()])).alias("x")).select("id", "x.*")
    known = surface.select(surface_hash.alias("h")).distinct()
    return own.join(known, "h", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("flags"))


def gram_hits(df: DataFrame, banned: DataFrame, *, low: int = 8, key: str = "id", text: str = "body") -> DataFrame:
    """Keys of ``df`` that share a word n-gram of order ``low`` or a higher one with ``banned`` (text), both in NFC.

    The banned grams of the lowest order decide: a longer shared gram has a shorter one within it. Grams travel as
    64-bit hashes to find candidates, which are then compared as text.
    """
    composed = lambda x: F.when(x.rlike("[^\\x00-\\x7f]"), udfs.nfc(x)).otherwise(x)
    banned_grams = banned.select(F.explode(T.word_grams(composed(F.col("text")), low, low)).alias("gram")).distinct().withColumn("h", F.xxhash64("gram"))
    own = df.select(key, F.explode(T.word_grams(composed(F.col(text)), low, low)).alias("gram")).withColumn("h", F.xxhash64("gram"))
    return own.join(banned_grams.select(F.col("h"), F.col("gram").alias("_g")), "h").where("gram = _g").select(key).distinct()


def decontaminated(df: DataFrame, banned: DataFrame, **options) -> DataFrame:
    key = options.get("key", "id")
    return df.join(gram_hits(df, banned, **options), key, "left_anti")


def head_split(df: DataFrame, strata: list[str], order: list[str], fraction: float) -> DataFrame:
    """``split``: holdout for the first ceil(fraction * n) rows of each stratum, else train."""
    w = Window.partitionBy(*strata)
    n = F.row_number().over(w.orderBy(*order))
    return df.withColumn("split", F.when(n <= F.ceil(F.lit(fraction) * F.count("*").over(w)), "holdout").otherwise("train"))


def unit_split(df: DataFrame, unit: str, strata: list[str], fraction: float) -> DataFrame:
    """As head_split over units, whose rows stay together; a unit's stratum is its least."""
    units = df.groupBy(unit).agg(*[F.min(s).alias(s) for s in strata])
    return df.join(head_split(units, strata, [unit], fraction).select(unit, "split"), unit)


def folds(df: DataFrame, k: int, strata: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("fold", (F.row_number().over(Window.partitionBy(*strata).orderBy(*order)) - 1) % k)


def top_k_per_node(pairs: DataFrame, k: int = 3) -> DataFrame:
    """Pairs (a, b, similarity) that are among the k best of either end; ties to the smaller pair."""
    ends = pairs.select("a", "b", "similarity", F.explode(F.array("a", "b")).alias("node"))
    best = ends.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy(F.col("similarity").desc(), "a", "b"))).where(F.col("_n") <= k)
    return pairs.join(best.select("a", "b").distinct(), ["a", "b"], "left_semi")


def capped_quota(df: DataFrame, group: str, cap: int, quota: int, order: list[str]) -> DataFrame:
    """The first ``quota`` rows with at most ``cap`` of a group; if that is short, rows beyond the cap follow."""
    within = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_over", (within > cap).cast("int")).orderBy("_over", *order).limit(quota).drop("_over")


def shared_cap_quota(df: DataFrame, strata: list[tuple[str, int]], cap: int, *, group: str = "component", order: str = "pair_id") -> DataFrame:
    """Strata in turn take their quota; a group gives ``cap`` rows over all strata together."""
    taken, counts = None, None
    for name, quota in strata:
        own = df.where(F.col("stratum") == name)
        own = own.join(counts, group, "left") if counts is not None else own.withColumn("_used", F.lit(0))
        n = F.row_number().over(Window.partitionBy(group).orderBy(order)) + F.coalesce("_used", F.lit(0))
        picked = own.withColumn("_n", n).where(F.col("_n") <= cap).orderBy(order).limit(quota).select(*df.columns)
        taken = picked if taken is None else taken.union(picked)
        counts = taken.groupBy(group).agg(F.count("*").alias("_used"))
    return taken


def round_robin(df: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """One row of each group after another, up to ``cap`` rows."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("turn", n).orderBy("turn", group).limit(cap)


def with_position(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with its position (from 0) in a total order: range-partitioned, counted by partition, numbered within."""
    sorted_ = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order).persist()
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_size"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return sorted_.withColumn("_own", own).join(starts, "_part").withColumn("position", F.col("_own") + F.col("_start")).drop("_part", "_own", "_start")


def every_nth(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """A systematic sample: every ``n``-th row of the order, beginning with the first."""
    return with_position(df, order).where(F.col("position") % n == 0).drop("position")


def even_spread(df: DataFrame, group: str, order: list[str], quota: int) -> DataFrame:
    """``quota`` rows of each group at even distances, both ends among them; all rows of smaller groups."""
    w = Window.partitionBy(group)
    x = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(quota - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / max(1, quota - 1) + 0.5))
    return x.where((F.col("_n") <= quota) | F.array_contains(wanted, F.col("_i").cast("bigint"))).drop("_i", "_n")


def stride_split(df: DataFrame, group: str, order: list[str], fraction: float) -> DataFrame:
    """``picked``: of n rows of a group max(1, round(n * fraction)) at places floor(i * n / k)."""
    w = Window.partitionBy(group)
    x = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * fraction + 0.5)).cast("bigint")
    # row i is picked if some j has floor(j * n / k) = i: the least j with j * n / k >= i must stay below i + 1
    j = F.ceil(F.col("_i") * k / F.col("_n"))
    return x.withColumn("picked", (j < k) & (F.floor(j * F.col("_n") / k) == F.col("_i"))).drop("_i", "_n")


def largest_remainder(counts: DataFrame, total: int, floor: int = 0) -> DataFrame:
    """family, allocated: ``total`` seats in proportion to n, the rest by the largest remainders, at least ``floor`` each."""
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    share = F.lit(total) * F.col("n") / F.sum("n").over(whole)
    x = counts.withColumn("_share", share).withColumn("_base", F.floor("_share"))
    left = F.lit(total) - F.sum("_base").over(whole)
    rank = F.row_number().over(Window.orderBy((F.col("_share") - F.col("_base")).desc(), "family"))
    return x.withColumns({"_left": left, "_rank": rank}).select("family", F.greatest(F.lit(floor), F.col("_base") + (F.col("_rank") <= F.col("_left")).cast("int")).cast("bigint").alias("allocated"))


def first_per_class(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The first ``k`` rows of each class; a class with fewer fails the query."""
    w = Window.partitionBy(key)
    x = df.withColumns({"_i": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    ok = F.when(F.col("_n") >= k, F.col("_i")).otherwise(F.raise_error(F.concat(F.lit("class is short: "), F.col(key))).cast("int"))
    return x.where(ok <= k).drop("_i", "_n")


def injection(unlabelled: int, gold: int, duplicates: int, share: float) -> int:
    """How many rows to inject so that duplicates are ``share`` of the mixture; halves round up."""
    import math

    return math.floor((share * (unlabelled + gold) - duplicates) / (1 - share) + 0.5)


def spaced_pick(df: DataFrame, group: str, value: str, quota: int, gap: float) -> DataFrame:
    """Greedy: by rising value, rows at least ``gap`` apart, up to ``quota`` a group. Sequential within a group's bounded bin."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], float("-inf")
        for i, v in pdf[value].sort_values(kind="stable").items():
            if len(kept) < quota and v - last >= gap:
                kept.append(i)
                last = v
        return pdf.loc[kept]

    return df.groupBy(group).applyInPandas(pick, df.schema)


def largest_gap_pick(df: DataFrame, group: str, value: str, quota: int) -> DataFrame:
    """Greedy coverage: the ends, then always the row nearest the middle of the largest gap."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value, kind="stable").reset_index(drop=True)
        v, kept = pdf[value].to_numpy(), []
        if len(v):
            kept = sorted({0, len(v) - 1})
        while len(kept) < min(quota, len(v)):
            spans = sorted(((v[a] - v[b], b, a) for b, a in zip(kept, kept[1:], strict=False) if a - b > 1), key=lambda s: (-s[0], s[1]))
            if not spans:
                break
            _, b, a = spans[0]
            middle = (v[a] + v[b]) / 2
            kept = sorted([*kept, min(range(b + 1, a), key=lambda i: (abs(v[i] - middle), i))])
        return pdf.loc[kept[:quota]]

    return df.groupBy(group).applyInPandas(pick, df.schema)


def packed_notes(df: DataFrame, group: str, *, least: int = 2, most: int = 4, size: int = 400) -> DataFrame:
    """Rows (group, position, text) in order, packed greedily into notes of 2 to 4 rows with at most ``size`` characters."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values("position", kind="stable")
            note, held, out, length = 0, 0, [], 0
            for n in pdf["text"].str.len():
                if held == most or (held >= least and length + n > size):
                    note, held, length = note + 1, 0, 0
                out.append(note)
                held, length = held + 1, length + n
            yield pdf.assign(note=out)

    return df.groupBy(group).applyInPandas(lambda pdf: next(pack(iter([pdf]))), f"{df._jdf.schema().toDDL()}, note bigint")
