"""Reciprocal rank fusion, reranking and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def rrf(candidates: DataFrame, top_k: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """query_id, chunk_id, ref_id, score, n_channels, rank of candidates (query_id, channel, chunk_id, ref_id, rank).

    A chunk counts once for each channel, at its best rank; ranks below 1 are dropped.
    """
    best = candidates.where("rank >= 1").groupBy("query_id", "chunk_id", "ref_id", "channel").agg(F.min("rank").alias("r"))
    fused = best.groupBy("query_id", "chunk_id", "ref_id").agg(F.round(F.sum(1.0 / (F.lit(config.rrf_k) + F.col("r"))), 9).alias("score"), F.count("*").alias("n_channels"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id", "ref_id")
    fused = fused.withColumn("rank", F.row_number().over(w).cast("long"))
    return fused if top_k is None else fused.where(F.col("rank") <= top_k)


def rerank(hits: DataFrame, scorer: Column, top_k: int | None = None) -> DataFrame:
    """Hits with rerank_score and a new rank; score stays. A scorer that gives no finite number is an error."""
    s = F.when(scorer.isNull() | F.isnan(scorer) | (F.abs(scorer) == float("inf")), F.raise_error(F.lit("the reranker gave no finite score"))).otherwise(scorer)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "chunk_id")
    out = hits.withColumn("rerank_score", F.round(s, 9)).withColumn("rank", F.row_number().over(w).cast("long"))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def lexical_overlap(query: Column, payload: Column) -> Column:
    """Share of a query's distinct words that occur in a payload: stands in where no model is at hand."""
    q, p = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != "")), F.split(F.lower(payload), r"\s+")
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, p)) / F.size(q))


def retrieval_metrics(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: queries, recall_at_1, recall_at_3, mrr over labels (query_id, ref_id)."""
    first = labels.select("query_id", "ref_id").distinct().join(hits.select("query_id", "ref_id", "rank"), ["query_id", "ref_id"], "left").groupBy("query_id").agg(F.min("rank").alias("r"))
    hit = lambda k: F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 9)
    return first.agg(F.count("*").alias("queries"), hit(1).alias("recall_at_1"), hit(3).alias("recall_at_3"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 9).alias("mrr"))


def expand_queries(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Query texts followed by the expansions (term, expansion) of their words, in the order of the expansions' names."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("term"))
    extra = words.join(synonyms, "term").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("expansion")), " ").alias("extra"))
    return queries.join(extra, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "extra").alias("text"))
