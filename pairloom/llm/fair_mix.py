"""Mixing sources to target weights, by weighted fair queueing.

Each source is a queue of its documents in a shuffled order (a hash of seed, id and text). A document's virtual finish
time is what its source has served with it, in words, divided by the source's weight; the queue starts over when it
is through, up to ``repeats`` times. Serving by virtual finish time gives every source that still has words its weight's
share, and what exhausted sources leave goes to the others by weight. The queue is sorted by ranges of that time and
ends where the total budget is used up: at the virtual time V at which the sum of min(repeats * size, weight * V) is
the budget. A document in service at V has its words counted up to there.

Nothing is gathered by source: the hash order is cut into ranges, sums of (source, range) give what stands before a
range, and running sums stay within one. The ranges grow in number with the rows.

A null text has size 0; documents of size 0 are never taken. A null source is a source of its own, after all others.
Rows that are equal in id, text and source queue one after another. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD

#: Columns that the operator adds; input columns of these names are replaced.
ADDED = ("size", "source_size", "weight", "target", "virtual_start", "virtual_finish", "taken")


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, *, source: str, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """For each source: source_size, weight, target. One row for each source; sources by code point, null last.

    V lies where the budget is first reached when sources run out in the order of repeats * size / weight.
    """
    rows = sized.groupBy(F.col(source).alias("_of")).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("_of").asc_nulls_last())
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    cap = F.lit(repeats) * F.col("source_size")
    rows = rows.withColumn("_ends", cap / F.col("weight"))
    in_order = Window.orderBy("_ends", F.col("_of").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    rows = rows.withColumns({
        "_budget": F.lit(share) * F.sum("source_size").over(everything),
        "_used": F.coalesce(F.sum(cap).over(in_order), F.lit(0)),
        "_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(in_order), F.lit(0.0)),
    })
    # V if just this source and those that end later are still in service. From the first source on that outlasts it
    # these values fall, and the first, so the largest, is the true one.
    rows = rows.withColumn("_v", (F.col("_budget") - F.col("_used")) / F.col("_left"))
    v = F.coalesce(F.max(F.when(F.col("_v") <= F.col("_ends"), F.col("_v"))).over(everything), F.max("_ends").over(everything))
    return rows.withColumn("target", F.least(cap.cast("double"), F.col("weight") * v)).select("_of", "source_size", "weight", "target")


def schedule(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 17, rows_per_range: int = 1 << 16) -> DataFrame:
    """``df`` in the order of virtual finish time, with size, source_size, weight, target, virtual_start,
    virtual_finish (of the first service; each further one is source_size / weight later) and taken (words served,
    repeats counted)."""
    ranges = max(1024, -(-df.count() // rows_per_range))
    bits = (ranges - 1).bit_length()
    kept = [c for c in df.columns if c not in ADDED]
    docs = df.select(*kept, words(text).alias("size"), F.xxhash64(F.lit(seed), doc_id, text).alias("_at"), F.xxhash64(text).alias("_tie"))
    docs = docs.withColumn("_range", F.shiftrightunsigned("_at", 64 - bits)).withColumn("_of", F.col(source))
    per_source = targets(docs, source="_of", weights=weights, share=share, repeats=repeats)
    before_range = Window.partitionBy("_of").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs.groupBy("_of", "_range").agg(F.sum("size").alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before_range), F.lit(0))).drop("_sum")
    offsets = starts.join(per_source.withColumnRenamed("_of", "_of2"), F.col("_of").eqNullSafe(F.col("_of2"))).drop("_of2")
    offsets = offsets.select(F.col("_of").alias("_of1"), F.col("_range").alias("_range1"), "_start", "source_size", "weight", "target")
    placed = docs.join(offsets, F.col("_of").eqNullSafe(F.col("_of1")) & (F.col("_range") == F.col("_range1")))
    queue = Window.partitionBy("_of", "_range").orderBy("_at", doc_id, "_tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("size").over(queue), F.lit(0))
    placed = placed.withColumn("_before", before)
    budget = F.floor("target")
    served = [F.least(F.col("size"), F.greatest(F.lit(0), budget - F.lit(k) * F.col("source_size") - F.col("_before"))) for k in range(repeats)]
    timed = placed.withColumns({
        "virtual_start": F.col("_before") / F.col("weight"),
        "virtual_finish": (F.col("_before") + F.col("size")) / F.col("weight"),
        "taken": sum(served[1:], served[0]).cast("bigint"),
    })
    return timed.orderBy("virtual_finish", "_at", "_tie", F.col(doc_id)).select(*kept, *ADDED)


def mixed(df: DataFrame, **options) -> DataFrame:
    """The rows that the mix consists of, in the order of virtual finish time, with the columns of ``df``.

    Documents stay whole: of a document in service when the budget ends, the copy is kept if at least half was served.
    """
    times = schedule(df, **options)
    copies = F.expr("CASE WHEN size > 0 THEN cast(round(taken / size) AS int) ELSE 0 END")
    rows = times.withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    rows = rows.withColumn("_finish", F.col("virtual_finish") + (F.col("_copy") - 1) * F.col("source_size") / F.col("weight"))
    return rows.orderBy("_finish", "virtual_start", options.get("doc_id", "doc_id")).select(*df.columns)
