"""Evidence retrieval for requests: subqueries, coverage, query-level abstention and bundles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import hashing
from ..functions import vectors as vectors_
from ..tables import written
from . import bm25, fusion, guard, hybrid


@dataclass
class Evidence:
    """records: request_id, coverage_key, position and what guard.normalize_hits gives. coverage: request_id, coverage_key,
    hit_count, guardable_count, covered. bundles: one row for each request. diagnostics: one row for each subquery."""

    records: DataFrame
    coverage: DataFrame
    bundles: DataFrame
    diagnostics: DataFrame


def subqueries(requests: DataFrame) -> DataFrame:
    """request_id, position, coverage_key, query_id, text, allowed_ref_ids of requests (request_id, query, subqueries,
    coverage_keys, allowed_ref_ids). Without subqueries the query is the only one, without keys they are sq1, sq2 and so on.
    A request with neither, or with another number of keys than of subqueries, is an error."""
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    subs = F.coalesce(filled("subqueries"), F.when(F.coalesce("query", F.lit("")) != "", F.array("query")))
    d = requests.select("request_id", "allowed_ref_ids", subs.alias("s"), filled("coverage_keys").alias("k"))
    d = d.withColumn("s", F.when(F.col("s").isNull(), F.raise_error(F.lit("a request needs a query or subqueries")).cast("array<string>")).otherwise(F.col("s")))
    d = d.withColumn("k", F.coalesce("k", F.transform("s", lambda _, i: F.concat(F.lit("sq"), (i + 1).cast("string")))))
    d = d.withColumn("k", F.when(F.size("k") != F.size("s"), F.raise_error(F.lit("as many coverage keys as subqueries are needed")).cast("array<string>")).otherwise(F.col("k")))
    d = d.select("request_id", "allowed_ref_ids", "k", F.posexplode("s").alias("position", "text"))
    return d.select("request_id", "position", F.get("k", "position").alias("coverage_key"), F.concat_ws("#", F.col("request_id").cast("string"), "position").alias("query_id"), "text", "allowed_ref_ids")


def _embedded(queries: DataFrame, embed) -> DataFrame:
    """What embed() gives, if it is one finite vector for each query, all of one length; else an error."""
    out = written(embed(queries).select("query_id", "embedding"), "embedded")
    bad = out.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("ids"), F.count_distinct(F.size("embedding")).alias("sizes"), F.count_if(~F.coalesce(vectors_.finite(F.col("embedding")), F.lit(False))).alias("odd")).first()
    if bad.odd or bad.sizes > 1 or not bad.n == bad.ids == queries.count():
        raise ValueError("an embedder must give one finite vector for each query, all of one length")
    return out


def retrieve(
    requests: DataFrame, chunks: DataFrame, index: bm25.Index | None = None, vectors: DataFrame | None = None, embed=None, visible: DataFrame | None = None, hidden: DataFrame | None = None,
    top_k: int = 5, coarse_top_k: int = 10, default_type: str | None = "literature", config: Config = DEFAULT, synonyms: DataFrame | None = None, reranker=None,
) -> Evidence:
    """Evidence for requests: see subqueries() for what they hold; and required_coverage_keys (null: all keys),
    private_data_unauthorized and calibrated_support (null: not judged).

    Each subquery is a hybrid retrieval without fallback. Empty allowed_ref_ids are no restriction. visible: references
    (ref_id) that may be returned, as of the version asked for (lifecycle.eligibility); restricted requests lose those that are
    not. hidden: assertions or chunks that may not (see hybrid_retrieve). embed(rows) adds embedding to rows (query_id, text), for
    vectors; it must give one finite vector for each row. A request's own top_k and coarse_top_k, where it has these columns and
    they are not null, go before those of the call; requests that ask alike are answered together. synonyms, reranker: see
    hybrid_retrieve; bundle ids and records stay those of the texts as they were asked.
    """
    asked = written(subqueries(requests), "subqueries")
    searched = asked if synonyms is None else written(asked.drop("text").join(fusion.expand_queries(asked, synonyms), "query_id"), "expanded")
    source = index or bm25.Index.for_queries(searched, chunks)
    if hidden is not None:
        hidden = written(hybrid.hidden_chunks(hidden, *(x for x in (chunks, vectors) if x is not None)), "hidden")
    own = lambda c, k: F.coalesce(F.col(c).cast("int"), F.lit(k)) if c in requests.columns else F.lit(k)
    limited = F.coalesce(F.size("allowed_ref_ids"), F.lit(0)) > 0
    kinds = written(requests.select("request_id", own("top_k", top_k).alias("k"), own("coarse_top_k", coarse_top_k).alias("ck")), "depths")
    asked_as = searched.join(kinds, "request_id").withColumn("limited", limited)
    parts = []
    for r in asked_as.select("k", "ck", "limited").distinct().collect():  # a row for each pair of depths
        some = asked_as.where((F.col("k") == r.k) & (F.col("ck") == r.ck) & (F.col("limited") == r.limited))
        allowed = some.select("query_id", F.explode("allowed_ref_ids").alias("ref_id")).distinct() if r.limited else None
        q = some.select("query_id", "text")
        parts.append(hybrid.hybrid_retrieve(q, source, vectors, _embedded(q, embed) if embed else None, None, allowed, r.ck, r.k, False, config, visible, hidden, None, reranker, chunks))
    if not parts:
        none = asked.select("query_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("ref_id"), F.lit(None).cast("long").alias("rank"))
        hits, diagnostics = none.limit(0), asked.select("query_id").limit(0)
    else:
        hits, diagnostics = parts[0].hits, parts[0].diagnostics
        for p in parts[1:]:
            hits, diagnostics = hits.unionByName(p.hits), diagnostics.unionByName(p.diagnostics)
    keys = asked.select("request_id", "position", "coverage_key", "query_id")
    records = written(guard.normalize_hits(hits, chunks, default_type, config).join(keys, "query_id"), "records")
    covered = guard.coverage(keys.select(F.col("request_id").alias("bundle_id"), "coverage_key", "query_id"), records).withColumnRenamed("bundle_id", "request_id")
    return Evidence(records, covered, bundles(requests, asked, records, covered, config), diagnostics.join(keys, "query_id"))


def bundles(requests: DataFrame, asked: DataFrame, records: DataFrame, covered: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """request_id, bundle_id, abstain, reasons (in order), missing_keys (sorted), record_count, guardable_count.

    The id names the query, its subqueries and the chunks they found, in their order. A request abstains without the right to
    private data, with too little calibrated support, or where a required key has no record that could anchor a claim.
    """
    order = lambda rows, *by: F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda x: x[by[-1]])
    found = records.groupBy("request_id").agg(order(records, "position", "rank", "chunk_id").alias("h"), F.count("*").alias("record_count"), F.count_if("guardable").alias("guardable_count"))
    subs = asked.groupBy("request_id").agg(order(asked, "position", "text").alias("s"), order(asked, "position", "coverage_key").alias("k"))
    ok = covered.where("covered").groupBy("request_id").agg(F.collect_set("coverage_key").alias("ok"))
    d = requests.select("request_id", "query", "required_coverage_keys", "private_data_unauthorized", "calibrated_support")
    d = d.join(subs, "request_id").join(found, "request_id", "left").join(ok, "request_id", "left").fillna(0, ["record_count", "guardable_count"])
    none = F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(F.coalesce("required_coverage_keys", "k"), F.coalesce("ok", none)))
    text = lambda c: F.concat_ws("", F.transform(F.coalesce(c, none), lambda x: hashing.packed(x)))
    ident = F.concat(F.lit("evb_"), hashing.canonical_hash(F.col("query"), text("s"), text("h"), length=16))
    d = d.withColumn("missing_keys", missing)
    reasons = F.array_compact(F.array(
        F.when(F.coalesce("private_data_unauthorized", F.lit(False)), F.lit("private_data_unauthorized")), F.when(F.col("calibrated_support") < config.min_support, F.lit("low_retrieval_support")),
        F.when(F.size("missing_keys") > 0, F.lit("subquestion_not_covered")),
    ))
    return d.select("request_id", ident.alias("bundle_id"), (F.size(reasons) > 0).alias("abstain"), reasons.alias("reasons"), "missing_keys", "record_count", "guardable_count")
