"""Evidence records, claim policy, abstention and hallucination checks for batches of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIDENCE, DEFAULT, EVIDENCE_TYPES, Config
from ..functions import hashing, intervals
from ..functions import text as T
from ..tables import written


def evidence_type(explicit: Column, default: str | None = "literature") -> Column:
    """The type that provenance states, lower-cased; an unknown one is not replaced. Without one, the default."""
    t = F.lower(F.trim(explicit))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(default).cast("string")).when(t.isin(*EVIDENCE_TYPES), t)


def of_hits(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """The chunks of documents that have a hit; chunks without a column ref_id as they are. Hits are few, so
    that they are sent to the chunks, and other payloads are not shuffled."""
    if "ref_id" not in chunks.columns:
        return chunks
    refs = hits.select(F.col("ref_id").alias("_ref")).distinct()
    return chunks.join(refs, F.col("ref_id").eqNullSafe(F.col("_ref")), "left_semi")


def normalize_hits(hits: DataFrame, chunks: DataFrame, default_type: str | None = "literature", config: Config = DEFAULT) -> DataFrame:
    """query_id, rank, chunk_id, ref_id, locator, confidence, evidence_type, reasons, guardable, excerpt.

    chunks: chunk_id, payload, locator, confidence, evidence_type and, if they are made from documents, ref_id. reasons says what
    an anchor would lack. Hits are few and written, so that they are found once; where chunks have a ref_id, only payloads of
    documents with hits are joined.
    """
    hits = written(hits.select("query_id", "rank", "chunk_id", "ref_id"), "hits")
    r = hits.join(of_hits(chunks, hits).select("chunk_id", "payload", "locator", "confidence", F.col("evidence_type").alias("stated")), "chunk_id")
    kind = evidence_type(F.col("stated"), default_type)
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reasons = F.array_compact(
        F.array(
            F.when(empty(F.col("ref_id")), F.lit("missing_ref_id")), F.when(empty(F.col("locator")), F.lit("missing_locator")), F.when(F.col("confidence").isNull(), F.lit("missing_confidence")),
            F.when(kind.isNull(), F.when(empty(F.col("stated")), F.lit("missing_evidence_type")).otherwise(F.lit("invalid_evidence_type"))),
        )
    )
    r = r.select("query_id", "rank", "chunk_id", "ref_id", "locator", "confidence", kind.alias("evidence_type"), reasons.alias("reasons"), F.substring("payload", 1, config.excerpt).alias("excerpt"))
    return r.withColumn("guardable", F.size("reasons") == 0)


def coverage(keys: DataFrame, records: DataFrame) -> DataFrame:
    """bundle_id, coverage_key, hit_count, guardable_count, covered; a key without hits is listed too.

    keys: bundle_id, coverage_key, query_id: the subquery that answers each key.
    """
    n = records.groupBy("query_id").agg(F.count("*").alias("hit_count"), F.count_if("guardable").alias("guardable_count"))
    d = keys.join(n, "query_id", "left").fillna(0, ["hit_count", "guardable_count"])
    return d.select("bundle_id", "coverage_key", "hit_count", "guardable_count", (F.col("guardable_count") >= 1).alias("covered"))


def bundle_ids(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, bundle_id: named by the query and its hits in rank order."""
    ids = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("ids"))
    d = queries.join(ids, "query_id", "left")
    return d.select("query_id", F.concat(F.lit("evb_"), hashing.canonical_hash(F.col("text"), F.coalesce("ids", F.lit("")), length=16)).alias("bundle_id"))


def bind_anchors(claims: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each anchor of a claim: claim_id, chunk_id and, if the claim's query retrieved a guardable record of that
    chunk, its ref_id, locator, confidence and evidence_type; else they are null and the anchor is unresolved."""
    a = claims.select("claim_id", "query_id", F.posexplode("anchor_chunk_ids").alias("position", "chunk_id"))
    r = records.where("guardable").select("query_id", "chunk_id", "ref_id", "locator", "confidence", "evidence_type")
    return a.join(r, ["query_id", "chunk_id"], "left").select("claim_id", "position", "chunk_id", "ref_id", "locator", "confidence", "evidence_type", F.col("confidence").isNotNull().alias("resolved"))


def claim_policy(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """claim_id, policy, effective_confidence, n_anchors: the weakest anchor rules; disjoint source ranges must be disclosed."""
    a = anchors.where("resolved").groupBy("claim_id").agg(F.count("*").alias("n_anchors"), F.min(intervals.confidence_rank(F.col("confidence"))).alias("weakest"), F.max(intervals.confidence_rank(F.col("confidence"))).alias("strongest"))
    d = claims.join(a, "claim_id", "left").fillna(0, ["n_anchors"])
    disjoint = F.coalesce(intervals.ranges_disjoint(F.col("numeric_source_ranges")), F.lit(False))
    policy = (
        F.when(F.col("n_anchors") == 0, "abstain").when(disjoint, "conflict_disclosure_required").when(F.col("weakest") >= 2, "factual_allowed")
        .when(F.col("weakest") == 1, "caveated_only").otherwise("pending_hypothesis_only")
    )
    return d.select("claim_id", policy.alias("policy"), intervals.confidence_name(F.col("weakest")).alias("effective_confidence"), "n_anchors", "strongest")


def claim_abstain(claims: DataFrame, policies: DataFrame, covered: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """claim_id, abstain, reasons (in order). A claim without a resolved anchor abstains even if no reason is listed.

    covered: (query_id, coverage_key) with at least one guardable hit.
    """
    d = claims.join(policies.select("claim_id", "n_anchors", "strongest"), "claim_id").join(covered.select("query_id", "coverage_key", F.lit(True).alias("is_covered")).distinct(), ["query_id", "coverage_key"], "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("private_data_unauthorized"), F.lit("private_data_unauthorized")),
            F.when(F.col("calibrated_support") < config.min_support, F.lit("low_retrieval_support")),
            F.when((F.coalesce("coverage_key", F.lit("")) != "") & F.col("is_covered").isNull(), F.lit("subquestion_not_covered")),
            F.when(F.col("is_critical_numeric") & (F.coalesce("strongest", F.lit(0)) == 0), F.lit("critical_numeric_only_hypothesis_or_pending")),
            F.when(F.col("mechanism_supported").eqNullSafe(F.lit(False)), F.lit("unsupported_inference_no_mechanism")),
        )
    )
    return d.select("claim_id", ((F.size(reasons) > 0) | (F.col("n_anchors") == 0)).alias("abstain"), reasons.alias("reasons"))


def hallucination_h1(claims: DataFrame, anchors: DataFrame, refs: DataFrame, locators: DataFrame | None) -> DataFrame:
    """claim_id, finding, ref_id, locator_status: claims without anchor, unknown references, empty or absent locators.

    locators: (ref_id, locator) that exist; references not in it, or no table at all, are not_checked and no finding.
    An unknown reference whose locator is absent gives two findings.
    """
    ok = anchors.where("resolved").join(refs.select("ref_id", F.lit(True).alias("known")).distinct(), "ref_id", "left")
    if locators is None:
        status = F.lit("not_checked")
    else:
        index = locators.select("ref_id", F.trim("locator").alias("_l"), F.lit(True).alias("present")).distinct()
        ok = ok.withColumn("_l", F.trim("locator")).join(index, ["ref_id", "_l"], "left").join(locators.select("ref_id", F.lit(True).alias("indexed")).distinct(), "ref_id", "left")
        status = F.when(F.col("indexed").isNull(), "not_checked").when(F.col("present"), "verified_present").otherwise("verified_absent")
    ok = ok.withColumn("status", status)
    blank = F.coalesce(F.trim("locator"), F.lit("")) == ""
    found = F.array_compact(
        F.array(
            F.when(F.col("known").isNull(), F.struct(F.lit("ref_not_resolvable").alias("finding"), F.lit(None).cast("string").alias("locator_status"))),
            F.when(blank, F.struct(F.lit("locator_empty").alias("finding"), F.lit(None).cast("string").alias("locator_status"))),
            F.when(~blank & (F.col("status") == "verified_absent"), F.struct(F.lit("locator_absent").alias("finding"), F.lit("verified_absent").alias("locator_status"))),
        )
    )
    rows = ok.select("claim_id", "ref_id", F.explode(found).alias("f")).select("claim_id", "f.finding", "ref_id", "f.locator_status")
    bare = claims.select("claim_id").join(anchors.where("resolved").select("claim_id").distinct(), "claim_id", "left_anti")
    return rows.unionByName(bare.select("claim_id", F.lit("no_anchor").alias("finding"), F.lit(None).cast("string").alias("ref_id"), F.lit(None).cast("string").alias("locator_status")))


def hallucination_h2(claims: DataFrame, anchors: DataFrame, ref_metadata: DataFrame) -> DataFrame:
    """claim_id, finding, ref_id of literature anchors: unknown references, cited DOI or title other than the known one.

    claims: cited_ref_id, cited_doi, cited_title. A comparison needs both sides; what is not known is not a finding.
    """
    lit = anchors.where("resolved and evidence_type = 'literature'").select("claim_id", "ref_id")
    d = lit.join(claims.select("claim_id", "cited_ref_id", "cited_doi", "cited_title"), "claim_id").join(ref_metadata.select("ref_id", "title", "doi", F.lit(True).alias("known")), "ref_id", "left")
    cites = F.col("cited_ref_id") == F.col("ref_id")
    found = F.array_compact(
        F.array(
            F.when(F.col("known").isNull(), F.lit("ref_not_found")),
            F.when(F.col("known") & cites & (T.cited_doi(F.col("cited_doi")) != T.cited_doi(F.col("doi"))), F.lit("doi_mismatch")),
            F.when(F.col("known") & cites & (T.cited_title(F.col("cited_title")) != T.cited_title(F.col("title"))), F.lit("title_mismatch")),
        )
    )
    return d.select("claim_id", F.explode(found).alias("finding"), "ref_id")


def h2_status(claims: DataFrame, ref_metadata: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """claim_id, h2_checked, h2_status: whether what was cited could be compared at all.

    A claim cites if any of cited_ref_id, cited_doi and cited_title is there. A cited DOI or title needs the same of the
    reference's metadata: without metadata, a reference id included, or with none of what is asked, it is unavailable; with
    both asked and one lacking, partial. records: where a claim's query retrieved none, nothing could be checked.
    """
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    d = claims.join(ref_metadata.select(F.col("ref_id").alias("cited_ref_id"), "title", "doi", F.lit(True).alias("known")), "cited_ref_id", "left")
    doi, title = given(F.col("cited_doi")), given(F.col("cited_title"))
    cites = F.col("cited_ref_id").isNotNull() | F.col("cited_doi").isNotNull() | F.col("cited_title").isNotNull()
    lacks = (doi & ~given(F.col("doi"))) | (title & ~given(F.col("title")))
    empty = F.lit(False)
    if records is not None:
        d = d.join(records.select("query_id", F.lit(True).alias("retrieved")).distinct(), "query_id", "left")
        empty = F.col("retrieved").isNull()
    status = (
        F.when(empty, "metadata_unavailable").when(~cites & (F.size("anchor_chunk_ids") == 0), "not_applicable").when(~doi & ~title, "checked").when(F.col("known").isNull(), "metadata_unavailable")
        .when(~lacks, "checked").when(doi & title, "partial").otherwise("metadata_unavailable")
    )
    return d.select("claim_id", (status == "checked").alias("h2_checked"), status.alias("h2_status"))


def hallucination_h3(claims: DataFrame, violations: DataFrame | None) -> DataFrame:
    """claim_id, h3_status, violated of claims with an assertion_id: checked against mechanism violations (id), or
    mechanism_unavailable where there is no validator."""
    d = claims.select("claim_id", "assertion_id")
    if violations is None:
        return d.select("claim_id", F.when(F.col("assertion_id").isNull(), "not_checked").otherwise("mechanism_unavailable").alias("h3_status"), F.lit(False).alias("violated"))
    bad = violations.select(F.col("id").alias("assertion_id"), F.lit(True).alias("bad")).distinct()
    d = d.join(bad, "assertion_id", "left")
    return d.select("claim_id", F.when(F.col("assertion_id").isNull(), "not_checked").otherwise("checked").alias("h3_status"), F.coalesce("bad", F.lit(False)).alias("violated"))


def answer(records: DataFrame, queries: DataFrame, top: int = 3) -> DataFrame:
    """query_id, status, n_claims, anchors: an answer from the validated claims of the first records, else abstain.

    Each of the first `top` records, guardable or not, makes a claim of its excerpt, anchored on itself; a record without
    text ends the attempt. Claims then go through the guard: only those on a guardable record of high confidence may state
    facts. A query without a guardable record abstains before any claim is made.
    """
    first = F.slice(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "confidence", "guardable", "excerpt"))), 1, top)
    g = records.groupBy("query_id").agg(F.bool_or("guardable").alias("covered"), first.alias("r"))
    ok = F.filter("r", lambda x: x["guardable"] & (intervals.confidence_rank(x["confidence"]) >= CONFIDENCE.index("high")))
    silent = F.exists("r", lambda x: F.coalesce(x["excerpt"], F.lit("")) == "")
    d = queries.select("query_id").join(g.select("query_id", F.when(F.col("covered") & ~silent, ok).alias("ok")), "query_id", "left").withColumn("ok", F.coalesce("ok", F.array()))
    return d.select("query_id", F.when(F.size("ok") > 0, "answered").otherwise("abstain").alias("status"), F.size("ok").cast("long").alias("n_claims"), F.array_join(F.transform("ok", lambda x: x["chunk_id"]), ",").alias("anchors"))
