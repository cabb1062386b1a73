"""Probe sets and the gates that scores of them must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text as T

from .metrics import monotone, symmetric

#: Rungs of the cosine ladder (fixed values).
LADDER = (1.0, 0.99, 0.95, 0.8, 0.5)


def probe_set(topics: DataFrame, *, per_class: int = 8) -> DataFrame:
    """pair_id, class, grp, record_body, candidate_body, similarity, y: probes of the first topics (topic, title, body, other).

    identity and cosmetic pairs are duplicates, other topics and changed numbers are not; a ladder lowers the cosine of
    one pair; symmetric probes come in both directions.
    """
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy("topic"))
    t = topics.withColumn("_n", n).where(F.col("_n") <= per_class)
    made = lambda cls, body, cos, y, grp=None: t.select(F.lit(cls).alias("class"), (grp if grp is not None else F.lit(None).cast("string")).alias("grp"), F.col("body").alias("record_body"), body.alias("candidate_body"), F.lit(cos).cast("double").alias("similarity"), F.lit(y).alias("y"), "topic")
    ladder = None
    for cos in LADDER:
        own = made("ladder", F.col("body"), cos, cos >= 0.95, F.concat(F.lit("ladder-"), F.col("topic").cast("string")))
        ladder = own if ladder is None else ladder.union(own)
    numbers = F.translate(F.col("body"), "0123456789", "7000000000")
    pair = F.concat(F.lit("pair-"), F.col("topic").cast("string"))
    forward = made("symmetry", T.plain_marks(F.col("body")), 0.97, True, pair)
    reverse = forward.select("class", "grp", F.col("candidate_body").alias("record_body"), F.col("record_body").alias("candidate_body"), "similarity", "y", "topic")
    rows = made("identity", F.col("body"), 1.0, True).union(made("cosmetic", T.plain_marks(T.norm1(F.col("body"))), 0.98, True)).union(made("other-topic", F.col("other"), 0.5, False)).union(made("numbers", numbers, 0.97, False).where("record_body <> candidate_body")).union(ladder).union(forward).union(reverse)
    return rows.withColumn("pair_id", F.sha2(F.concat_ws("|", "class", F.col("topic").cast("string"), F.col("similarity").cast("string"), F.sha2("record_body", 256), F.sha2("candidate_body", 256)), 256))


def probe_gates(scored: DataFrame, required: dict[str, str], *, floor: float = 0.9, ceiling: float = 0.5) -> DataFrame:
    """gate, value, passed for each required class: its kind is floor (all p at least), ceiling (all at most), ladder or
    symmetry. A class without probes fails."""
    spark = scored.sparkSession
    wanted = spark.createDataFrame([*required.items()], "class string, kind string")
    lad = monotone(scored.where("class = 'ladder'"), "grp", [F.col("similarity").desc()], "p", zone=F.col("similarity") <= 0.95).agg(F.count_if(~F.col("ok")).alias("bad")).first()["bad"]
    sym = symmetric(scored.where("class = 'symmetry'"), "grp", "p").agg(F.count_if(~F.col("ok")).alias("bad")).first()["bad"]
    seen = scored.groupBy("class").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))
    x = wanted.join(seen, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    value = F.when(F.col("kind") == "floor", F.col("low")).when(F.col("kind") == "ceiling", F.col("high")).when(F.col("kind") == "ladder", F.lit(float(lad or 0))).otherwise(F.lit(float(sym or 0)))
    ok = F.when(F.col("kind") == "floor", F.col("low") >= floor).when(F.col("kind") == "ceiling", F.col("high") <= ceiling).when(F.col("kind") == "ladder", F.lit(not lad)).otherwise(F.lit(not sym))
    return x.select(F.col("class").alias("gate"), "kind", "n", value.alias("value"), ((F.col("n") > 0) & F.coalesce(ok, F.lit(False))).alias("passed"))


def holdout_gates(decided: DataFrame, *, accuracy: float = 0.9, abstention: float = 0.8) -> DataFrame:
    """From (cluster, stratum, label_type, verdict, right): accuracy over all, share of strata that are all right, and how
    often a cluster that must not be decided isn't."""
    one = decided.agg(F.avg(F.col("right").cast("double")).alias("g_acc"), F.avg(F.when(F.col("label_type") == "abstain", (F.col("verdict") == "abstain").cast("double"))).alias("g_abstain"))
    exact = decided.groupBy("stratum").agg(F.bool_and("right").alias("all")).agg(F.avg(F.col("all").cast("double")).alias("g_exact"))
    x = one.crossJoin(exact)
    return x.withColumns({"acc_ok": F.col("g_acc") >= accuracy, "abstain_ok": F.coalesce(F.col("g_abstain") >= abstention, F.lit(True))})


def noise_floor(draws: DataFrame, value: str = "accuracy", least: float = 0.1) -> DataFrame:
    """delta by which a model must beat a baseline: the spread of draws between P5 and P95, at least ``least``."""
    spread = F.percentile(value, F.lit(0.95)) - F.percentile(value, F.lit(0.05))
    return draws.agg(F.greatest(F.lit(least), spread).alias("delta"), (F.max(value) - F.min(value)).alias("max_pairwise"))


def no_harm(metrics: DataFrame, previous: float) -> DataFrame:
    """Whether balanced accuracy stays above the previous one less the larger of 0.02 and its 95 % half width."""
    half = 1.96 * F.sqrt(F.lit(previous * (1 - previous)) / F.col("n"))
    bound = F.lit(previous) - F.greatest(F.lit(0.02), half)
    return metrics.select("n", "balanced_accuracy", F.round(bound, 6).alias("bound"), (F.col("balanced_accuracy") >= bound).alias("passed"))
