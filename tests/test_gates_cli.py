from pyspark.sql import functions as F

from pairloom.__main__ import main
from pairloom.operators import gates
from pairloom.operators.features import CORE


def test_probe_gates(spark):
    topics = spark.createDataFrame([(i, f"T{i}", f"Body “{i}” with 1{i} numbers…", "something else entirely") for i in range(12)], "topic long, title string, body string, other string")
    probes = gates.probe_set(topics)
    counts = {r["class"]: r["count"] for r in probes.groupBy("class").count().collect()}
    assert counts == {"identity": 8, "cosmetic": 8, "other-topic": 8, "numbers": 8, "ladder": 40, "symmetry": 16} and probes.select("pair_id").distinct().count() == 88
    need = {"identity": "floor", "numbers": "ceiling", "ladder": "ladder", "symmetry": "symmetry", "absent": "floor"}
    good = probes.withColumn("p", F.when(F.col("y"), F.col("similarity")).otherwise(0.1))
    assert {r.gate: r.passed for r in gates.probe_gates(good, need).collect()} == {"identity": True, "numbers": True, "ladder": True, "symmetry": True, "absent": False}
    bad = probes.withColumn("p", F.when(F.col("class") == "ladder", 1 - F.col("similarity")).otherwise(F.rand(1)))
    got = {r.gate: r.passed for r in gates.probe_gates(bad, need).collect()}
    assert not got["ladder"] and not got["symmetry"]


def test_holdout_and_floor(spark):
    d = spark.createDataFrame([(1, "a", "keep", "keep", True), (2, "a", "abstain", "abstain", True), (3, "b", "keep", "abstain", False)], "cluster long, stratum string, label_type string, verdict string, right boolean")
    r = gates.holdout_gates(d).first()
    assert round(r.g_acc, 4) == 0.6667 and r.g_exact == 0.5 and r.g_abstain == 1.0 and not r.acc_ok and r.abstain_ok
    draws = spark.createDataFrame([(0.5 + i / 100,) for i in range(11)], "accuracy double")
    assert round(gates.noise_floor(draws, least=0.05).first().delta, 4) == 0.09
    m = spark.createDataFrame([(400, 0.93)], "n long, balanced_accuracy double")
    assert gates.no_harm(m, 0.95).first().passed and not gates.no_harm(m.withColumn("balanced_accuracy", F.lit(0.9)), 0.95).first().passed


def test_verbs(spark, sf_dir, tmp_path):
    p = str(tmp_path)
    assert main(["nonsense"]) == 2 and main(["run", "no_such_query", sf_dir, f"{p}/x"]) == 3
    assert main(["export", sf_dir, f"{p}/records", "--limit", "5"]) == 0 and spark.read.parquet(f"{p}/records").count() == 5
    assert main(["run", "edge_nodes", sf_dir, f"{p}/nodes"]) == 0 and spark.read.parquet(f"{p}/nodes").count() > 0
    rows = spark.range(60).select(F.concat(F.lit("p"), "id").alias("pair_id"), F.when(F.col("id") % 2 == 0, "duplicate").otherwise("not-duplicate").alias("label"), *[((F.col("id") % 2) * 0.5 + F.col("id") / 200).alias(c) for c in CORE])
    rows.write.parquet(f"{p}/labelled")
    assert main(["train", f"{p}/labelled", f"{p}/model"]) == 0 and main(["score", f"{p}/model", f"{p}/labelled", f"{p}/scores"]) == 0
    spark.read.parquet(f"{p}/scores").withColumn("y", F.col("label") == "duplicate").write.parquet(f"{p}/scored")
    assert main(["evaluate", f"{p}/scored", f"{p}/log"]) == 0 and main(["evaluate", f"{p}/scored", f"{p}/log"]) == 4
