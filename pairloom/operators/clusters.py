"""Which member of a duplicate cluster is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import CORE, pair_features
from .metrics import choosers, decide
from .silver import cluster_class, zone


def member_features(members: DataFrame, similarities: DataFrame) -> DataFrame:
    """cluster, member: the CORE pair terms averaged over the other members (``similarities``: a, b, similarity within clusters)."""
    records = members.select(F.col("member").alias("id"), "title", "body", "tags", "language", "record_type").dropDuplicates(["id"])
    pairs = pair_features(similarities.select("a", "b", "similarity"), records).select("a", "b", *CORE)
    both = pairs.select(F.col("a").alias("member"), *CORE).union(pairs.select(F.col("b"), *CORE))
    own = members.select("cluster", "member")
    return both.groupBy("member").agg(*[F.avg(c).alias(c) for c in CORE]).join(own, "member")


def arbitrate(members: DataFrame, zones: DataFrame, tau_hi: float, tau_m: float, declarations: DataFrame | None = None) -> DataFrame:
    """cluster, leg, verdict, member: equal clusters keep the oldest, metadata clusters and those in the zone abstain, the
    others go to the scores. ``zones``: cluster, cos, c5, z, the least similar pair of each."""
    cls = cluster_class(members, declarations)
    x = cls.join(choosers(members).select("cluster", "oldest"), "cluster").join(decide(members, tau_hi, tau_m), "cluster")
    hit = zones.groupBy("cluster").agg(F.bool_or(zone(F.col("cos"), F.col("c5"), F.col("z"))).alias("hit"))
    x = x.join(hit, "cluster", "left")
    same = F.col("class").isin("CH-0", "CH-5")
    leg = F.when(same, "keep-oldest").when(F.col("class") == "CH-2", "metadata").when(F.coalesce("hit", F.lit(False)), "zone").otherwise("model")
    x = x.withColumn("leg", leg)
    keep = F.when(F.col("leg") == "keep-oldest", F.col("oldest")).when(F.col("leg") == "model", F.col("member"))
    return x.select("cluster", "leg", F.when(keep.isNotNull(), "keep").otherwise("abstain").alias("verdict"), keep.alias("member"))


def one_to_one(members: DataFrame) -> DataFrame:
    """cluster, ok: the declared facts (cluster, member, fact) assign every member facts that no other member has."""
    per = members.groupBy("cluster", "fact").agg(F.count_distinct("member").alias("n"))
    return per.groupBy("cluster").agg((F.max("n") == 1).alias("ok"))


def right_choice(label_type, label_member, verdict, member):
    """Whether a decision is right: the labelled member is kept, any is where all may be, none where none may."""
    return F.when(label_type == "keep", (verdict == "keep") & (member == label_member)).when(label_type == "eligible-all", verdict == "keep").otherwise(verdict == "abstain")
