"""python -m pairloom VERB: export, features, train, score, evaluate, run. Exit codes: 0 done, 2 usage, 3 refused input, 4 evaluated before."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairloom")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, names in {"export": ("store", "out"), "features": ("store", "out"), "train": ("labelled", "out"), "score": ("model", "rows", "out"), "evaluate": ("scored", "log"), "run": ("query", "tables", "out")}.items():
        sub = verbs.add_parser(verb)
        for n in names:
            sub.add_argument(n)
    verbs.choices["export"].add_argument("--limit", type=int)
    return p


def act(a: argparse.Namespace, spark: SparkSession) -> int:
    from pairloom.operators import fingerprints, hygiene, metrics, models
    from pairloom.plans import queries
    from pairloom.sources import tables

    if a.verb == "export":
        hygiene.select_candidates(tables.records(spark, a.store), limit=a.limit).write.parquet(a.out)
    elif a.verb == "features":
        queries.feats(spark, a.store).write.parquet(a.out)
    elif a.verb == "train":
        rows = spark.read.parquet(a.labelled)
        if rows.where("label NOT IN ('duplicate', 'not-duplicate', 'disputed')").limit(1).count():
            return 3
        rows = rows.where("label <> 'disputed'").withColumn("y", F.col("label") == "duplicate")
        model, platt_a, platt_b = models.train(rows)
        digest = rows.select("pair_id", F.sha2(F.concat_ws("|", "pair_id", "label"), 256).alias("d"))
        models.save(model, a.out, name="pair", version="1", fingerprint=fingerprints.chained_digest(digest, F.col("d")).first()[0], a=platt_a, b=platt_b)
    elif a.verb == "score":
        model, manifest = models.load(spark, a.model)
        models.score(spark.read.parquet(a.rows), model, *manifest["platt"]).write.parquet(a.out)
    elif a.verb == "evaluate":
        rows = spark.read.parquet(a.scored)
        corpus = fingerprints.chained_digest(rows, F.sha2("pair_id", 256)).first()[0]
        result = metrics.binary_metrics(rows).withColumn("fingerprint", F.lit(corpus))
        if tables.append_log(result, a.log, "fingerprint"):
            return 4
        result.show(truncate=False)
    else:
        if a.query not in queries.QUERIES:
            return 3
        queries.QUERIES[a.query](spark, a.tables).write.parquet(a.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    return act(a, SparkSession.builder.appName("pairloom").getOrCreate())


if __name__ == "__main__":
    sys.exit(main())
