"""The driver's tables, and frames derived from them that stand for decision data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probs as P


#: Bytes of an Arrow batch that is sent to a Python worker, as in llm: 10,000 long texts would be a gigabyte.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def train_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as training items: id, state, source, lang, ordinal."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("state"), "source", "lang", F.col("doc_id").alias("ordinal"))


def held_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("state"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a prediction dump: id, type, lang, tier, k, gold, logits, p, target, and the derived conf, hit."""
    e = table(spark, sf_dir, "embeddings")
    kind = F.col("vec_id") % 3
    k = F.when(kind == 0, 4).when(kind == 1, 2).otherwise(5)
    rows = e.select(
        F.col("vec_id").alias("id"),
        F.when(kind == 0, "choice").when(kind == 1, "noul").otherwise("score").alias("type"),
        F.when(F.col("vec_id") % 2 == 0, "en").otherwise("fr").alias("lang"),
        F.element_at(F.array(F.lit("easy"), F.lit("standard"), F.lit("judge"), F.lit("hard")), (F.col("vec_id") % 4 + 1).cast("int")).alias("tier"),
        k.alias("k"), (F.col("label") % k).alias("gold"),
        F.transform(F.slice("embedding", F.lit(1), k), lambda x: x.cast("double") * 4).alias("logits"),
    )
    rows = rows.withColumn("p", P.softmax(F.col("logits"))).withColumn("target", P.one_hot(F.col("gold"), F.col("k")))
    return rows.withColumn("conf", F.array_max("p")).withColumn("hit", F.when(P.argmax(F.col("p")) == F.col("gold"), 1.0).otherwise(0.0))


#: The same in DuckDB: a list of common table expressions that ends in `pred`.
PRED = """
pred0 AS (
  SELECT vec_id AS id, CASE vec_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'noul' ELSE 'score' END AS type,
    CASE WHEN vec_id % 2 = 0 THEN 'en' ELSE 'fr' END AS lang, (['easy', 'standard', 'judge', 'hard'])[vec_id % 4 + 1] AS tier,
    CASE vec_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 5 END AS k, label, embedding FROM embeddings),
pred1 AS (SELECT id, type, lang, tier, k, label % k AS gold, [x::DOUBLE * 4 FOR x IN embedding[1:k]] AS logits FROM pred0),
pred2 AS (SELECT *, [exp(x - list_max(logits)) FOR x IN logits] AS e FROM pred1),
pred3 AS (SELECT * EXCLUDE (e), [x / list_sum(e) FOR x IN e] AS p FROM pred2),
pred AS (SELECT *, [CASE WHEN i = gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR i IN range(k)] AS target, list_max(p) AS conf,
  CASE WHEN list_position(p, list_max(p)) - 1 = gold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM pred3)
"""
