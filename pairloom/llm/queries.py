"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, byte_bpe, byte_cnn, fair_mix, jaccard_join, langid, pq_dedup, prefix_counts, token_store, toxicity
from .learning import remainder
from .shared import fresh_path, vocabulary


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def scores(docs: DataFrame, modulus: int, rest: int, cut: float) -> DataFrame:
    return docs.select("doc_id", F.coalesce(remainder("doc_id", modulus) == rest, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.fit(docs, labels_of(spark, sf_dir).where(remainder("doc_id", 3) != 1))
    return scores(toxicity.scored(docs, model), 3, 1, 0.7)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir, "doc_id", "text"), k=3, percent=90)


def op3_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    index, blocks = bitsliced.build_index(vectors)
    return bitsliced.search(index, blocks, vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.ints, c.ints) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.ints) = len(c.ints)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts.with_prefix_counts(documents(spark, sf_dir, "doc_id", "text"), model_path=vocabulary("word_bpe_49k.json"), outputs=("n_tokens",))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op5_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.95)


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.n)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
FROM embeddings AS e JOIN (SELECT n, min(m) AS m FROM r GROUP BY n) AS c ON c.n = e.vec_id
"""


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write(documents(spark, sf_dir, "doc_id", "text"), fresh_path(spark, "token-store"), model_path=vocabulary("word_bpe_49k.json"))
    return token_store.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.schedule(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    net = byte_cnn.fit(docs, labels_of(spark, sf_dir).where(remainder("doc_id", 5) != 0))
    return scores(byte_cnn.scored(docs, net), 5, 0, 0.3)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    docs = documents(spark, sf_dir, "doc_id", "text")
    return byte_bpe.encoded(docs, ranks_path=vocabulary("byte_bpe_50k.tiktoken"), pattern=PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.fit(docs.where(remainder("doc_id", 4) != 2))
    found = langid.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_bitsliced": op3_bitsliced,
    "op4_prefix_counts": op4_prefix_counts,
    "op5_pq_dedup": op5_pq_dedup,
    "op6_token_store": op6_token_store,
    "op7_fair_mix": op7_fair_mix,
    "op8_byte_cnn": op8_byte_cnn,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_langid": op10_langid,
}

ORACLE_SQL: dict[str, str] = {
    "op3_bitsliced": OP3_SQL,
    "op5_pq_dedup": OP5_SQL,
}
