"""Queries of problems 6, 7 and 8 over the reviews, and those of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathlume.llm import frequent_queries
from pathlume.llm.moderation import THRESHOLD, Moderator, fitted, labelled_rows, score_column
from pathlume.llm.packing import DEFAULT_CAPACITY, container_use, pack
from pathlume.llm.tokenizer import encode_column, token_counts
from pathlume.sources.tables import read_table
from pathlume.sources.workspace import written


def _spread(documents: DataFrame) -> DataFrame:
    """Texts dealt evenly over the cores where the scan has fewer splits than there are cores; otherwise as scanned, without a shuffle."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return documents if documents.rdd.getNumPartitions() >= cores else documents.repartition(2 * cores, "doc_id")


def p6_ids(spark: SparkSession, data_dir: str) -> DataFrame:
    documents = read_table(spark, data_dir, "documents").select("doc_id", "text")
    return encode_column(_spread(documents), "text").select("doc_id", "ids")


def p6_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows, rows without ids, and least number of ids of the others."""
    n = F.size("ids")
    return p6_ids(spark, data_dir).agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(n == 0).alias("n_without"), F.count_if(F.col("ids").isNull()).alias("n_null"))


def p7_packed(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every text's pieces and their containers."""
    documents = read_table(spark, data_dir, "documents").select("doc_id", "text")
    return pack(token_counts(_spread(documents), "text").select("doc_id", "n_tokens"), "doc_id", "n_tokens")


def p7_containers(spark: SparkSession, data_dir: str) -> DataFrame:
    """How full and how costly every container is."""
    return container_use(p7_packed(spark, data_dir)).withColumn("cost", F.round("cost", 3))


def p7_holds(spark: SparkSession, data_dir: str) -> DataFrame:
    """What must hold of the packing, in one row: containers over their capacity, overlapping pieces, texts whose pieces do not make up
    their size, texts that were cut though they fit, and whether the containers are 98 % full where there are a hundred or more."""
    packed = written(p7_packed(spark, data_dir), "packed")
    by_place = W.partitionBy("container_id").orderBy("offset")
    placed = packed.filter("container_id is not null").withColumn("before", F.lag(F.col("offset") + F.col("piece_size"), 1, 0).over(by_place))
    containers = placed.groupBy("container_id").agg(F.sum("piece_size").alias("used"), F.count_if(F.col("offset") != F.col("before")).alias("apart"))
    texts = packed.groupBy("doc_id").agg(F.sum("piece_size").alias("whole"), F.max("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n"))
    full = F.sum("used") >= 0.98 * DEFAULT_CAPACITY * F.count(F.lit(1))
    of_containers = containers.agg(F.count_if(F.col("used") > DEFAULT_CAPACITY).alias("n_over"), F.coalesce(F.sum("apart"), F.lit(0)).alias("n_apart"), (full | (F.count(F.lit(1)) < 100)).alias("full"))
    of_texts = texts.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("whole") != F.col("n_tokens")).alias("n_partial"), F.count_if((F.col("n") > 1) & (F.col("n_tokens") <= DEFAULT_CAPACITY)).alias("n_cut"))
    return of_containers.withColumn("one", F.lit(1)).join(of_texts.withColumn("one", F.lit(1)), "one").drop("one")  # one row each


def moderator(spark: SparkSession, data_dir: str) -> Moderator:
    """Fitted to the labelled sentences and generated ones; no review has a part in it."""
    return fitted(spark, labelled_rows(read_table(spark, data_dir, "moderation_examples")))


def p8_scores(spark: SparkSession, data_dir: str) -> DataFrame:
    """Score and category of every review."""
    model = moderator(spark, data_dir)
    documents = read_table(spark, data_dir, "documents").select("doc_id", "source", "text")
    return score_column(_spread(documents), "text", model).drop("text")


def p8_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return p8_scores(spark, data_dir).filter(F.col("score") >= THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per source: reviews, harmful ones and their rate, and the mean score. Reviews without a source come as one row with a null."""
    return (
        p8_scores(spark, data_dir)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_reviews"), F.count_if(F.col("score") >= THRESHOLD).alias("n_harmful"), F.avg("score").alias("mean_score"))
        .withColumn("rate", F.col("n_harmful") / F.col("n_reviews"))
    )


QUERIES = {**frequent_queries.QUERIES, "p6_ids": p6_ids, "p6_counts": p6_counts, "p7_packed": p7_packed, "p7_holds": p7_holds, "p7_containers": p7_containers, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL: dict[str, str] = {
    **frequent_queries.SQL,
    "p6_counts": "select count(*) as n_documents, count(*) filter (where coalesce(text, '') = '') as n_without, 0::bigint as n_null from documents",
    "p7_holds": "select 0::bigint as n_over, 0::bigint as n_apart, true as full, count(*) as n_documents, 0::bigint as n_partial, 0::bigint as n_cut from documents",
}
