"""Counters, metrics and gates over labelled and scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import CORE

#: Bands of the cosine histogram: from, to (fixed values); the last is 1 itself.
BANDS = ((0.0, 0.4), (0.4, 0.55), (0.55, 0.7), (0.7, 0.85), (0.85, 0.95), (0.95, 1.0))
CEILING = ("cos_target", "char3_jaccard", "char4_jaccard", "char5_jaccard", "char3_containment", "char4_containment", "char5_containment")
TOL = 1e-9
#: Bounds of the corpus gates: counter, whether the bound is a least or a most, its value (fixed values).
GATES = (
    ("clone_negatives", "most", 0.0), ("corner_dup_positives", "least", 10.0), ("identity_positives", "least", 60.0), ("metadata_negatives", "least", 40.0), ("fact_edit_negatives", "least", 75.0),
    ("razor_zone_positives", "most", 0.0), ("type_present", "least", 0.85), ("lang_present", "least", 0.85), ("type_mismatch", "least", 0.03), ("lang_mismatch", "least", 0.05),
    ("cos_below_055", "least", 5.0), ("cos_below_070", "least", 60.0), ("cos_below_084", "least", 180.0), ("low_cos_high_overlap", "least", 30.0), ("constant_features", "most", 0.0),
)


def corner_facts(features: DataFrame) -> DataFrame:
    """Facts of each pair that the corpus counters count (needs CORE, label, a_/b_ title and tags)."""
    f = F.col
    still = (f("title_len_delta") == 0) & (f("body_len_delta") == 0) & (f("tag_count_delta") == 0)
    same = f("char5_jaccard") >= 1 - TOL
    meta = (f("tag_jaccard") < 1 - TOL) | (f("type_match") == 0) | (f("lang_match") == 0)
    razor = f("char5_jaccard").between(0.977, 1) & (f("char5_jaccard") < 1 - TOL) & (f("char5_containment") >= 0.995) & (f("cos_target") >= 0.995) & still
    return features.withColumns({"positive": f("label") == "duplicate", "still": still, "text_identical": same, "metadata_differs": meta, "razor_zone": razor, "title_differs": ~f("a_title").eqNullSafe(f("b_title"))})


def corner_counters(features: DataFrame) -> DataFrame:
    """One row of corpus counters, made in one pass."""
    f, x = F.col, corner_facts(features)
    pos, neg, n = f("positive"), ~f("positive"), F.count("*")
    present = lambda c: F.count_if(f(f"a_{c}").isNotNull()) + F.count_if(f(f"b_{c}").isNotNull())
    share = lambda c: F.round(c / F.when(n > 0, n), 4)
    counters = {
        "pairs": n, "positives": F.count_if(pos), "clone_negatives": F.count_if(neg & f("text_identical") & ~f("metadata_differs")),
        "corner_dup_positives": F.count_if(pos & (f("char4_jaccard") > 0.99) & (f("body_len_delta") == 0)), "identity_positives": F.count_if(pos & f("text_identical") & f("still")),
        "metadata_negatives": F.count_if(neg & f("text_identical") & ~f("title_differs") & (f("body_len_delta") == 0) & f("metadata_differs")),
        "fact_edit_negatives": F.count_if(neg & (f("char5_jaccard") >= 0.85) & (f("char5_jaccard") < 1 - TOL)), "razor_zone_positives": F.count_if(pos & f("razor_zone")),
        "low_cos_high_overlap": F.count_if(neg & (f("similarity") < 0.7) & (f("char3_containment") >= 0.9) & (f("char5_containment") >= 0.9)),
        "type_present": F.round(present("record_type") / F.when(n > 0, 2 * n), 4), "lang_present": F.round(present("language") / F.when(n > 0, 2 * n), 4),
        "type_mismatch": share(F.count_if(f("type_match") == 0)), "lang_mismatch": share(F.count_if(f("lang_match") == 0)),
        "cos_below_055": F.count_if(f("similarity") < 0.55), "cos_below_070": F.count_if(f("similarity") < 0.7), "cos_below_084": F.count_if(f("similarity") < 0.84),
    }
    constant = sum((F.coalesce(F.min(c) == F.max(c), F.lit(True)).cast("int") for c in CORE[1:]), F.coalesce(F.min(CORE[0]) == F.max(CORE[0]), F.lit(True)).cast("int"))
    return x.agg(*[c.alias(k) for k, c in counters.items()], constant.alias("constant_features"))


def corner_gates(counters: DataFrame, gates=GATES) -> DataFrame:
    """rule, value, bound, passed."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("value"), F.lit(k).alias("kind"), F.lit(b).alias("bound")) for n, k, b in gates]))
    return counters.select(rows.alias("g")).select("g.*").withColumn("passed", F.when(F.col("kind") == "least", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound")))


def cos_histogram(df: DataFrame, column: str = "similarity") -> DataFrame:
    """Rows in each band of BANDS; below 0 and above 1 in none."""
    c = F.col(column)
    band = F.lit(None).cast("string")
    for lo, hi in reversed(BANDS):
        band = F.when((c >= lo) & (c < hi), F.lit(f"[{lo}, {hi})")).otherwise(band)
    return df.withColumn("band", F.when(F.abs(c - 1) <= TOL, "[1.0]").otherwise(band)).where("band IS NOT NULL").groupBy("band").agg(F.count("*").alias("n"))


def distinct_values(features: DataFrame, names=CORE) -> DataFrame:
    """feature, n_distinct, constant."""
    sums = features.agg(*[F.count_distinct(n).alias(n) for n in names])
    return sums.selectExpr(f"stack({len(names)}, {', '.join(f"'{n}', `{n}`" for n in names)}) AS (feature, n_distinct)").withColumn("constant", F.col("n_distinct") < 2)


def distinct_by_name(values: DataFrame, names=CORE) -> DataFrame:
    """feature, n_distinct, constant of rows (feature, value), each value once or more often; features without values have 0."""
    counts = values.distinct().groupBy("feature").agg(F.count("value").alias("n"))
    every = values.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("feature"))
    return every.join(counts, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_distinct")).withColumn("constant", F.col("n_distinct") < 2)


def ceilings(features: DataFrame, names=CEILING) -> DataFrame:
    """feature, max_positive, max_negative: a negative may not lie above the positives."""
    sums = features.agg(*[F.round(F.max(F.when(F.col("label") == lab, F.col(n))), 6).alias(f"{n}_{s}") for n in names for lab, s in (("duplicate", "p"), ("not-duplicate", "n"))])
    return sums.selectExpr(f"stack({len(names)}, {', '.join(f"'{n}', `{n}_p`, `{n}_n`" for n in names)}) AS (feature, max_positive, max_negative)")


def confusion(truth: Column, predicted: Column) -> dict[str, Column]:
    return {"n": F.count("*"), "tp": F.count_if(truth & predicted), "fp": F.count_if(~truth & predicted), "tn": F.count_if(~truth & ~predicted), "fn": F.count_if(truth & ~predicted)}


def binary_metrics(scored: DataFrame, by: list[str] | None = None, *, cut: float = 0.5, digits: int = 6) -> DataFrame:
    """sensitivity, specificity (0 without the class), balanced accuracy, Brier of (y boolean, p), for each of ``by``."""
    y, p = F.col("y"), F.col("p")
    g = (scored.groupBy(*by) if by else scored.groupBy()).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.when(y, (p >= cut).cast("double"))), F.lit(0.0)).alias("sensitivity"), F.coalesce(F.avg(F.when(~y, (p < cut).cast("double"))), F.lit(0.0)).alias("specificity"), F.avg((p - y.cast("double")) ** 2).alias("brier"))
    g = g.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)
    return g.withColumns({c: F.round(c, digits) for c in ("sensitivity", "specificity", "brier", "balanced_accuracy")})


def class_breakdown(scored: DataFrame, by: str = "class", *, cut: float = 0.5) -> DataFrame:
    """The confusion of each class; a share is null where the class lacks its rows."""
    y, p = F.col("y"), F.col("p")
    g = scored.groupBy(by).agg(*[c.alias(k) for k, c in confusion(y, p >= cut).items()], F.round(F.avg("p"), 6).alias("mean_p"))
    return g.withColumns({"sensitivity": F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6), "specificity": F.round(F.try_divide("tn", F.col("tn") + F.col("fp")), 6)})


def percentile_summary(df: DataFrame, value: str, by: list[str] | None = None, least: float = 0.85) -> DataFrame:
    """n, share at least ``least``, exact median, P10, P90 (linear), mean, min, max."""
    v = F.col(value)
    q = lambda x: F.round(F.percentile(v, F.lit(x)), 4)
    return (df.groupBy(*by) if by else df.groupBy()).agg(F.count("*").alias("n"), F.round(F.avg((v >= least).cast("double")), 4).alias("share"), q(0.5).alias("median"), q(0.1).alias("p10"), q(0.9).alias("p90"), F.round(F.avg(v), 4).alias("mean"), F.round(F.min(v), 4).alias("min"), F.round(F.max(v), 4).alias("max"))


def distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.round(F.percentile(v, F.lit(0.05)), 6).alias("p5"), F.round(F.percentile(v, F.lit(0.95)), 6).alias("p95"), F.round(F.max(v) - F.min(v), 6).alias("max_diff"))


def monotone(df: DataFrame, group: str, order: list[Column], value: str, *, zone: Column | None = None, tolerance: Column | float = 1e-6) -> DataFrame:
    """group, steps, ok: along the order the value never rises by more than the tolerance (only steps that begin in the zone)."""
    w = Window.partitionBy(group).orderBy(*order)
    x = df.withColumns({"_next": F.lead(value).over(w), "_zone": F.lit(True) if zone is None else zone})
    t = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    x = x.withColumn("_bad", F.col("_zone") & F.col("_next").isNotNull() & (F.col("_next") > F.col(value) + t))
    return x.groupBy(group).agg(F.count_if(F.col("_zone") & F.col("_next").isNotNull()).alias("steps"), (F.count_if("_bad") == 0).alias("ok"))


def plateau_tolerance(value: str, group: str, order: list[Column], high: float = 0.99, wide: float = 1e-4, narrow: float = 1e-6) -> Column:
    nxt = F.lead(value).over(Window.partitionBy(group).orderBy(*order))
    return F.when((F.col(value) >= high) & (nxt >= high), wide).otherwise(narrow)


def symmetric(df: DataFrame, group: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    spread = F.max(value) - F.min(value)
    return df.groupBy(group).agg(F.round(spread, 6).alias("spread"), (spread <= tolerance).alias("ok"))


def gaps(df: DataFrame, value: str, low: float, high: float, by: str | None = None) -> DataFrame:
    """n, max_gap within the band, edge_gap to its borders."""
    keys = [by] if by else []
    band = df.where(F.col(value).between(low, high))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    x = band.withColumn("_gap", F.col(value) - F.lag(value).over(w.orderBy(value)))
    edge = F.greatest(F.min(value) - F.lit(low), F.lit(high) - F.max(value))
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.max("_gap"), 6).alias("max_gap"), F.round(edge, 6).alias("edge_gap"))


def marginals(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair of values, of each value of either, and of all."""
    return df.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def select_rule(runs: DataFrame) -> DataFrame:
    """From rows (candidate D or N, ba_mean, ba_std, brier_mean, brier_std) which candidate wins: N if better by more than
    one deviation in both; without any spread a strict improvement is enough; D where N is missing."""
    one = runs.groupBy().agg(*[F.max(F.when(F.col("candidate") == c, F.col(k))).alias(f"{c}_{k}") for c in "DN" for k in ("ba_mean", "ba_std", "brier_mean", "brier_std")])
    better = (F.col("N_ba_mean") - F.col("D_ba_mean") > F.greatest("D_ba_std", "N_ba_std")) & (F.col("D_brier_mean") - F.col("N_brier_mean") > F.greatest("D_brier_std", "N_brier_std"))
    return one.select(F.when(F.coalesce(better, F.lit(False)), "N").otherwise("D").alias("winner"))


def threshold_grid(members: DataFrame, highs: list[float], margins: list[float]) -> DataFrame:
    """tau_hi, tau_m, acc, abstain, score for every pair of thresholds over clusters' (e1, e2, right)."""
    spark = members.sparkSession
    grid = spark.createDataFrame([(h, m) for h in highs for m in margins], "tau_hi double, tau_m double")
    keep = (F.col("e1") >= F.col("tau_hi")) & (F.col("e1") - F.col("e2") >= F.col("tau_m"))
    x = members.crossJoin(F.broadcast(grid)).groupBy("tau_hi", "tau_m").agg(F.avg((keep & F.col("right")).cast("double")).alias("acc"), F.avg((~keep).cast("double")).alias("abstain"))
    return x.withColumns({"score": F.round(F.col("acc") - F.col("abstain"), 6), "acc": F.round("acc", 6), "abstain": F.round("abstain", 6)})


def decide(members: DataFrame, tau_hi: float, tau_m: float) -> DataFrame:
    """cluster, verdict, member, e1, e2: the best score if it is high and clear enough, ties to the oldest, then the id."""
    w = Window.partitionBy("cluster").orderBy(F.col("score").desc(), "created", "member")
    x = members.withColumn("_n", F.row_number().over(w)).where("_n <= 2").groupBy("cluster").agg(F.max(F.when(F.col("_n") == 1, F.col("member"))).alias("member"), F.max(F.when(F.col("_n") == 1, F.col("score"))).alias("e1"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("e2"))
    x = x.withColumn("e2", F.coalesce("e2", "e1"))
    keep = (F.col("e1") >= tau_hi) & (F.col("e1") - F.col("e2") >= tau_m)
    return x.select("cluster", F.when(keep, "keep").otherwise("abstain").alias("verdict"), F.when(keep, F.col("member")).alias("member"), F.round("e1", 6).alias("e1"), F.round("e2", 6).alias("e2"))


def choosers(members: DataFrame) -> DataFrame:
    """cluster, oldest, longest, first: the members that simple rules keep; ties to the smaller id."""
    key = lambda *c: F.struct(*c)
    return members.groupBy("cluster").agg(F.min_by("member", key("created", "member")).alias("oldest"), F.min_by("member", key(-F.length("body"), F.col("member"))).alias("longest"), F.min("member").alias("first"))


def windows(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Events of each window and type: count, mean value and share of errors."""
    return events.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def in_segments(events: DataFrame, segments: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """``events`` (epoch) with the segment (segment, start, stop) whose half-open interval they lie in.

    An equi-join on time buckets: a segment is filed under each bucket it touches, an event under its own.
    """
    s = segments.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket_seconds), F.floor((F.col("stop") - 1) / bucket_seconds))))
    return events.withColumn("_b", F.floor(F.col("epoch") / bucket_seconds)).join(s, "_b").where("epoch >= start AND epoch < stop").drop("_b")
