"""Coarse-to-fine hybrid retrieval and progressive eligibility."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..tables import written
from . import bm25, fusion, vector


@dataclass
class Retrieval:
    hits: DataFrame
    coarse: DataFrame
    diagnostics: DataFrame
    channels: DataFrame


def channel(frame: DataFrame, name: str) -> DataFrame:
    return frame.select("query_id", F.lit(name).alias("channel"), "chunk_id", "ref_id", "rank")


def hybrid_retrieve(
    queries: DataFrame, chunks: DataFrame | bm25.Index, vectors: DataFrame | None = None, vector_queries: DataFrame | None = None, graph: DataFrame | None = None,
    allowed: DataFrame | None = None, coarse_top_k: int = DEFAULT.coarse_top_k, fine_top_k: int = DEFAULT.fine_top_k, fallback: bool = True, config: Config = DEFAULT, visible: DataFrame | None = None, hidden: DataFrame | None = None,
    synonyms: DataFrame | None = None, reranker: Callable[[Column, Column], Column] | None = None, payloads: DataFrame | None = None,
) -> Retrieval:
    """Keyword and vector candidates on coarse chunks pick documents; fine chunks of those are fused.

    Fine channels are keyword, vector and graph (query_id, chunk_id, ref_id, rank); the graph takes no part in the coarse
    stage. A query without coarse hits falls back to all documents, or returns nothing where fallback is off. allowed:
    (query_id, ref_id) pairs; None for no restriction. visible: references (ref_id) that any query may return; statistics and
    ranks still cover the whole index, and each channel goes as deep as it must (see progressive). hidden: assertions
    (assertion_id) or chunks (chunk_id) that no query may return, in the same way; assertions need chunks that name theirs, see
    hidden_chunks(). chunks: chunks, which are indexed once for both stages, or a stored index. What the coarse stage picks is written, as both stages and the
    diagnostics read it.

    synonyms: (term, expansion) rows that widen the queries' texts in both stages (fusion.expand_queries). reranker(query, payload):
    a column that scores the fused hits anew from the widened text and the chunk's payload; a score that is no finite number is an
    error. score stays that of the fusion, rerank_score and rank are the reranker's. Payloads come from chunks, or from payloads
    (chunk_id, payload) where chunks is a stored index; a hit without one is scored on an empty payload. channels_used of the
    diagnostics names what the fine stage asked.
    """
    if reranker is not None and payloads is None:
        if isinstance(chunks, bm25.Index):
            raise ValueError("to rerank hits of a stored index, payloads are needed")
        payloads = chunks
    if synonyms is not None:
        queries = fusion.expand_queries(queries, synonyms)
    search = bm25.searcher(queries, chunks, config)
    limits = visible is not None or hidden is not None
    if hidden is not None:
        hidden = written(hidden_chunks(hidden, *(x for x in (chunks, vectors) if isinstance(x, DataFrame))), "hidden")
    if allowed is not None and visible is not None:
        allowed = allowed.join(visible.select("ref_id"), "ref_id", "left_semi")

    def cut(scores: DataFrame, k: int, keep: bool = False) -> DataFrame:
        return eligible_hits(bm25.ranked(scores, None, keep), visible, k, config, hidden) if limits else bm25.ranked(scores, k, keep)

    def wide(find, asked: DataFrame, k: int) -> DataFrame:
        return progressive(find, asked, visible, k, config, hidden) if limits else find(asked, k)

    def keyword(level: str):
        return lambda asked, k: search.top(k, level, queries=asked)

    if allowed is not None:
        coarse = channel(cut(search.pairs(allowed, "coarse"), coarse_top_k), "keyword")
    else:
        coarse = channel(wide(keyword("coarse"), queries, coarse_top_k), "keyword")
    if vectors is not None:
        # Filters come before ranks: where references are restricted, exactly those pairs are scored.
        if allowed is not None:
            dense = cut(vector.score_pairs(allowed, vector_queries, vectors), coarse_top_k, True)
        else:
            near = lambda asked, k: vector.vector_topk(vector_queries.join(asked.select("query_id"), "query_id", "left_semi"), vectors, k)
            dense = wide(near, vector_queries, coarse_top_k)
        coarse = coarse.unionByName(channel(dense, "vector"))
    picked = written(fusion.rrf(coarse, coarse_top_k, config), "coarse-hits")
    status = queries.select("query_id").join(picked.groupBy("query_id").agg(F.count("*").alias("coarse_hits")), "query_id", "left").fillna(0, ["coarse_hits"])
    refs = picked.select("query_id", "ref_id").distinct()
    found = channel(cut(search.pairs(refs, "fine"), fine_top_k), "keyword")
    lost = status.where("coarse_hits = 0").select("query_id")
    if fallback and not lost.isEmpty():
        rest = cut(search.pairs(allowed.join(lost, "query_id", "left_semi"), "fine"), fine_top_k) if allowed is not None else wide(keyword("fine"), lost, fine_top_k)
        found = found.unionByName(channel(rest, "keyword"))
    if vectors is not None:
        found = found.unionByName(channel(cut(vector.score_pairs(refs, vector_queries, vectors), fine_top_k, True), "vector"))
    if graph is not None:
        graph = graph if hidden is None else graph.join(hidden, "chunk_id", "left_anti")
        found = found.unionByName(channel(graph.join(refs, ["query_id", "ref_id"], "left_semi").where(F.col("rank") <= fine_top_k), "graph"))
    hits = fusion.rrf(found, fine_top_k, config)
    if reranker is not None:
        hits = _reranked(hits, queries, payloads, reranker)
    asked = [name for name, port in (("vector", vectors), ("graph", graph), ("keyword", chunks)) if port is not None]
    counts = hits.groupBy("query_id").agg(F.count("*").alias("fine_hits"))
    diagnostics = status.join(counts, "query_id", "left").fillna(0, ["fine_hits"]).select(
        "query_id", "coarse_hits", "fine_hits", F.when(F.col("coarse_hits") > 0, "ok").when(F.lit(fallback), "fallback").otherwise("empty").alias("coarse_status"), ((F.col("coarse_hits") == 0) & F.lit(fallback)).alias("fallback_used"),
        F.when((F.col("coarse_hits") > 0) | F.lit(fallback), F.lit(",".join(asked))).otherwise("").alias("channels_used"),
    )
    channels = found.groupBy("query_id", "channel").agg(F.count("*").alias("candidates"))
    return Retrieval(hits, picked, diagnostics, channels)


def _reranked(hits: DataFrame, queries: DataFrame, payloads: DataFrame, reranker: Callable[[Column, Column], Column]) -> DataFrame:
    """Hits are few, chunks many: the payloads of the hits alone leave the chunks. A chunk that is there twice counts once."""
    hits = written(hits, "fused-hits")
    texts = payloads.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("payload").alias("_payload"))
    rows = hits.join(texts, "chunk_id", "left").join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    return fusion.rerank(rows, reranker(F.col("_query"), F.coalesce("_payload", F.lit("")))).select("query_id", "chunk_id", "ref_id", "score", "n_channels", "rerank_score", "rank")


def hidden_chunks(hidden: DataFrame, *chunks: DataFrame) -> DataFrame:
    """chunk_id of the chunks whose assertion is hidden. hidden names chunks itself (chunk_id) or assertions (assertion_id); then some
    of chunks must have the column assertion_id, as nothing would be hidden otherwise."""
    if "chunk_id" in hidden.columns:
        return hidden.select("chunk_id").distinct()
    named = [c.select("chunk_id", "assertion_id") for c in chunks if "assertion_id" in c.columns]
    if not named:
        raise ValueError("to hide assertions, chunks must name theirs in assertion_id")
    out = named[0]
    for c in named[1:]:
        out = out.unionByName(c)
    return out.join(hidden.select("assertion_id").distinct(), "assertion_id", "left_semi").select("chunk_id").distinct()


def _eligible(rows: DataFrame, refs: DataFrame | None, hidden: DataFrame | None) -> DataFrame:
    if refs is not None:
        rows = rows.join(refs.select("ref_id").distinct(), "ref_id", "left_semi")
    return rows if hidden is None else rows.join(hidden_chunks(hidden, rows), "chunk_id", "left_anti")


def progressive(find: Callable[[DataFrame, int], DataFrame], queries: DataFrame, eligible: DataFrame | None, target: int, config: Config = DEFAULT, hidden: DataFrame | None = None) -> DataFrame:
    """Eligible rows of a search that widens until each query has target of them: query_id, chunk_id, ref_id, rank.

    find(queries, depth) gives ranked rows. The depth starts at first_depth and doubles for the queries that still lack
    eligible rows while the search fills it; at the deepest that is an error. Ranks keep their gaps. eligible: references
    (ref_id); None for all. hidden: chunks (chunk_id) that are not eligible, or assertions (assertion_id) whose chunks are not; then
    rows that do not name theirs are an error. A round asks only for what is lacking, never for all pairs.
    """
    asked, depth, out = queries.select("query_id").distinct(), config.first_depth, None
    while True:
        rows = written(find(asked, depth), "search-round")
        good = _eligible(rows, eligible, hidden)
        size = rows.groupBy("query_id").agg(F.count("*").alias("size")).join(good.groupBy("query_id").agg(F.count("*").alias("good")), "query_id", "left")
        lacking = written(size.where(f"size >= {depth} and coalesce(good, 0) < {target}").select("query_id"), "search-lacking")
        good = good.join(lacking, "query_id", "left_anti").select("query_id", "chunk_id", "ref_id", "rank")
        out = good if out is None else out.unionByName(good)
        if lacking.isEmpty():
            return out
        if 2 * depth > config.deepest:
            raise RuntimeError("too few eligible rows within the deepest search")
        asked, depth = lacking, 2 * depth


def eligible_hits(ranked: DataFrame, eligible: DataFrame | None, target: int, config: Config = DEFAULT, hidden: DataFrame | None = None) -> DataFrame:
    """Eligible rows of ranked (query_id, chunk_id, ref_id, rank) down to the depth that a widening search would reach.

    The search doubles its depth from first_depth until it has target eligible rows. In closed form the depth is the first
    one at or below the rank of the target-th eligible row. Ranks keep their gaps. A query with too few eligible rows keeps
    all it has if its rows end before the deepest search, else it is an error.
    """
    w = Window.partitionBy("query_id")
    size = ranked.groupBy("query_id").agg(F.max("rank").alias("size"))
    rows = _eligible(ranked, eligible, hidden)
    rows = rows.withColumn("seen", F.count("*").over(w.orderBy("rank"))).withColumn("target_rank", F.min(F.when(F.col("seen") >= target, F.col("rank"))).over(w))
    doubled = F.ceil(F.log2(F.greatest(F.col("target_rank") / config.first_depth, F.lit(1.0))))
    depth = F.lit(config.first_depth) * F.pow(F.lit(2.0), doubled)
    rows = rows.join(size, "query_id").withColumn("depth", F.when(F.col("target_rank").isNotNull(), depth).when(F.col("size") < config.deepest, F.col("size")).otherwise(F.raise_error(F.lit("too few eligible rows within the deepest search"))))
    return rows.where("rank <= depth").select("query_id", "chunk_id", "ref_id", "rank")
