"""Readers and writers. Schemas are explicit, malformed input fails, and nothing is inferred."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("title", T.StringType()), ("body", T.StringType()), ("tags", T.ArrayType(T.StringType())), ("language", T.StringType()), ("record_type", T.StringType()), ("created", T.LongType()), ("status", T.StringType()), ("source", T.StringType()))])
SIDE = T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("language", T.StringType()), T.StructField("record_type", T.StringType())])
PAIR = T.StructType([T.StructField("pair_id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("stratum", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("record", SIDE), T.StructField("candidate", SIDE)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as records: a title, tags, nullable language, a type, a creation time and a status."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"), F.array("source", "lang").alias("tags"),
        F.when(d % 10 != 0, F.col("lang")).alias("language"), F.element_at(F.array(F.lit("note"), F.lit("snippet"), F.lit("fact")), (d % 3 + 1).cast("int")).alias("record_type"),
        (F.lit(1704067200) + d * 60).alias("created"), F.when(d % 13 == 0, "draft").otherwise("published").alias("status"), "source",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, others must fit the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a row, its fields in the order of their names, nulls kept."""
    df.select(*[f"`{c}`" for c in sorted(df.columns)]).write.option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV, also compressed by bzip2, which Spark splits."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, sep=sep, header=header)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids, a line each, in their order; blank lines are skipped, ``--`` in an id and an empty file are refused."""
    lines = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
    checked = lines.withColumn("id", F.when(F.col("id").contains("--"), F.raise_error(F.concat(F.lit("separator in id "), "id"))).otherwise(F.col("id")))
    if lines.isEmpty():
        raise ValueError(f"no ids in {path}")
    return checked


def store_tables(path: str | None = None, uri: str | None = None) -> str:
    """Where a store's tables are: a folder, or a URI that must ask for read-only access; exactly one of them."""
    if (path is None) == (uri is None):
        raise ValueError("give either a path or a URI")
    if uri is not None and "mode=ro" not in uri:
        raise ValueError("a store is read with mode=ro only")
    return path if path is not None else uri.split("?")[0]


def read_store(spark: SparkSession, name: str, path: str | None = None, uri: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{store_tables(path, uri)}/{name}.parquet")


def read_database(spark: SparkSession, url: str, query: str) -> DataFrame:
    """A relational store by JDBC; the filter and the columns of ``query`` are the database's work."""
    return spark.read.format("jdbc").option("url", url).option("query", query).load()


def append_log(df: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key the log hasn't yet; returns how many of ``df`` were refused."""
    spark = df.sparkSession
    try:
        known = spark.read.schema(df.schema).parquet(path)
        new = df.dropDuplicates([key]).join(known.select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = df.dropDuplicates([key])
    new = new.persist()
    n = new.count()
    new.write.mode("append").parquet(path)
    new.unpersist()
    return df.count() - n


def float_vector(blob: str | Column) -> Column:
    """Little-endian 32-bit floats of a binary column, as an array."""
    @F.arrow_udf("array<float>")
    def run(blobs: pa.Array) -> pa.Array:
        return pa.array([None if b is None or len(b) % 4 else np.frombuffer(b, "<f4") for b in blobs.to_pylist()], pa.list_(pa.float32()))

    return run(F.col(blob) if isinstance(blob, str) else blob)


def strings_of_json(df: DataFrame, column: str, output: str = "value") -> DataFrame:
    """Every string in a nested JSON text, a row each."""
    def walk(x):
        if isinstance(x, str):
            yield x
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            yield from walk(y)

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append([*walk(json.loads(t))] if t is not None else [])
            except ValueError:
                out.append([])
        return pa.array(out, pa.list_(pa.string()))

    return df.withColumn(output, F.explode(run(F.col(column))))


def collect_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """The frames one below another, each row with its source's name and place in the order of sources."""
    out = None
    for i, (name, df) in enumerate(frames.items()):
        own = df.withColumns({"source_name": F.lit(name), "source_order": F.lit(i)})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
