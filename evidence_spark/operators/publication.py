"""Gates in front of the publication of a revision, and the check of what was committed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing

#: What a curation must be for its document to be published.
PUBLISHABLE_ACTIONS = ("accept", "downgrade")
BLOCKING_STATUS = ("return_upstream", "pending_review", "rejected")


def scope_hash(*columns: str):
    return hashing.canonical_hash(*(F.col(c) for c in columns), length=16)


def assertion_gaps(target: DataFrame, request: DataFrame) -> DataFrame:
    """package_id, ids_differ, material_differs: a package's target assertions against those of its commit request, both
    (package_id, id, material)."""
    r = request.select("package_id", "id", F.col("material").alias("asked"), F.lit(True).alias("there"))
    d = target.select("package_id", "id", "material", F.lit(True).alias("here")).join(r, ["package_id", "id"], "full_outer")
    return d.groupBy("package_id").agg(F.bool_or(F.col("here").isNull() | F.col("there").isNull()).alias("ids_differ"), F.bool_or(F.col("here") & F.col("there") & ~F.col("material").eqNullSafe(F.col("asked"))).alias("material_differs"))


def decision_gaps(target: DataFrame, decisions: DataFrame) -> DataFrame:
    """package_id, and whether its decisions (package_id, assertion_id, action) name no assertion, repeat one, name a foreign
    one, take an action that may not be published, or leave a target assertion out."""
    d = decisions.groupBy("package_id", F.col("assertion_id").alias("id")).agg(F.count("*").alias("n"), F.bool_or(~F.coalesce(F.col("action").isin(*PUBLISHABLE_ACTIONS), F.lit(False))).alias("unfit"))
    d = target.select("package_id", "id", F.lit(True).alias("here")).join(d, ["package_id", "id"], "full_outer")
    decided = F.col("n").isNotNull()
    return d.groupBy("package_id").agg(
        F.bool_or(decided & F.col("id").isNull()).alias("unnamed"), F.bool_or(F.coalesce("n", F.lit(0)) > 1).alias("repeated"), F.bool_or(decided & F.col("here").isNull()).alias("foreign"),
        F.bool_or(F.coalesce("unfit", F.lit(False))).alias("unfit"), F.bool_or(~decided).alias("undecided"),
    )


def _gates(scope: Column) -> list[tuple[str, str, Column]]:
    """(status, name, passes) of each gate, in order. p_ and n_ are the registry's rows of the prior and the new version."""
    c, same = F.col, lambda a, b: F.col(a).eqNullSafe(F.col(b))
    agrees = lambda a, b: (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "") | (a == b)
    asked = F.coalesce("requires_approval", F.lit(True))
    free = lambda x: ~asked | F.coalesce(x, F.lit(False))
    return [
        ("package_review_required", "review_required", ~F.coalesce("requires_manual_review", F.lit(False))),
        ("failed", "no_request", c("source_ref").isNotNull()),
        ("failed", "unknown_version", c("p_source_version_id").isNotNull() & c("n_source_version_id").isNotNull()),
        ("conflict", "prior_ref", same("p_ref_id", "prior_ref")),
        ("conflict", "new_ref", same("n_ref_id", "new_ref")),
        ("conflict", "relation", same("n_relation", "relation")),
        ("conflict", "work", same("p_work_id", "work_id") & same("n_work_id", "work_id")),
        ("conflict", "prior_version", same("n_prior_source_version_id", "p_source_version_id")),
        ("conflict", "bound_version", same("p_kb_version_id", "prior_bound_version")),
        ("conflict", "no_snapshot", F.coalesce("p_snapshot_id", F.lit("")) != ""),
        ("conflict", "fingerprint", same("source_fingerprint", "n_source_fingerprint")),
        ("failed", "invalid_request", (F.coalesce("source_fingerprint", F.lit("")) != "") & same("source_ref", "set_ref") & same("source_ref", "report_ref") & ~F.coalesce("request_errors", F.lit(False))),
        ("conflict", "source_ref", same("source_ref", "new_ref")),
        ("conflict", "assertion_ids", ~F.coalesce("ids_differ", F.lit(False))),
        ("conflict", "assertion_material", ~F.coalesce("material_differs", F.lit(False))),
        ("conflict", "title", agrees(c("title"), c("n_norm_title"))),
        ("conflict", "doi", agrees(c("doi"), c("n_norm_doi"))),
        ("conflict", "stable_id", agrees(c("stable_id"), c("n_norm_stable"))),
        ("failed", "unnamed_decision", ~F.coalesce("unnamed", F.lit(False))),
        ("failed", "repeated_decision", ~F.coalesce("repeated", F.lit(False))),
        ("conflict", "foreign_decision", ~F.coalesce("foreign", F.lit(False))),
        ("failed", "action", ~F.coalesce("unfit", F.lit(False))),
        ("failed", "undecided", ~F.coalesce("undecided", F.lit(False))),
        ("failed", "returned_upstream", F.coalesce("returned_upstream", F.lit(0)) == 0),
        ("failed", "report_status", ~F.lower(F.coalesce("report_status", F.lit(""))).isin(*BLOCKING_STATUS)),
        ("conflict", "existing_commit", ~F.coalesce("commit_differs", F.lit(False))),
        ("approval_required", "no_approval", free(c("approval_decision").isNotNull())),
        ("approval_rejected", "rejected", free(c("approval_decision") == "approved")),
        ("conflict", "approval_package", free(same("approval_package", "package_id"))),
        ("conflict", "approval_scope", free(c("approval_scope").eqNullSafe(scope))),
        ("approval_required", "approval_identity", free((F.coalesce("approval_id", F.lit("")) != "") & (F.coalesce("approver", F.lit("")) != ""))),
    ]


#: Columns of a package, its request and its approval that the gates read; those that are absent count as null.
TEXTS = ("source_ref", "source_fingerprint", "set_ref", "report_ref", "report_status", "prior_ref", "new_ref", "relation", "work_id", "prior_bound_version", "title", "doi", "stable_id", "approval_id", "approval_package", "approval_decision", "approval_scope", "approver")
MARKS = ("requires_manual_review", "requires_approval", "request_errors", "commit_differs", "ids_differ", "material_differs", "unnamed", "repeated", "foreign", "unfit", "undecided")


def publication_gate(packages: DataFrame, registry: DataFrame, target: DataFrame, request: DataFrame, decisions: DataFrame, scope: Column) -> DataFrame:
    """package_id, allowed, status, refused_by: the first gate that a package fails.

    packages: package_id, prior_id, new_id and what TEXTS, MARKS and returned_upstream name; title, doi and stable_id are
    normalized. registry: source versions (source_version_id, work_id, ref_id, relation, prior_source_version_id,
    source_fingerprint, kb_version_id, snapshot_id, norm_title, norm_doi, norm_stable). target and request: the assertions of the
    package and of its commit request (package_id, id, material). scope is the hash that an approval must name.
    """
    d = packages
    for name, kind in (*((c, "string") for c in TEXTS), *((c, "boolean") for c in MARKS if c not in ("ids_differ", "material_differs", "unnamed", "repeated", "foreign", "unfit", "undecided")), ("returned_upstream", "long")):
        if name not in d.columns:
            d = d.withColumn(name, F.lit(None).cast(kind))
    side = lambda p: registry.select(*(F.col(c).alias(f"{p}_{c}") for c in registry.columns))
    d = d.join(side("p"), F.col("prior_id") == F.col("p_source_version_id"), "left").join(side("n"), F.col("new_id") == F.col("n_source_version_id"), "left")
    d = d.join(assertion_gaps(target, request), "package_id", "left").join(decision_gaps(target, decisions), "package_id", "left")
    bad = F.coalesce(*(F.when(~F.coalesce(passes, F.lit(False)), F.struct(F.lit(status).alias("status"), F.lit(name).alias("refused_by"))) for status, name, passes in _gates(scope)))
    return d.select("package_id", bad.isNull().alias("allowed"), F.coalesce(bad["status"], F.lit("allowed")).alias("status"), bad["refused_by"].alias("refused_by"))


def tampered(admitted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """ref_id of snapshots (ref_id, content_hash) whose assertions no longer give the recorded hash."""
    now = admitted.groupBy("ref_id").agg(hashing.set_hash(F.col("assertion_hash")).alias("now"))
    return snapshots.join(now, "ref_id", "left").where("not (now <=> content_hash)").select("ref_id")


def committed_errors(committed: DataFrame, request: DataFrame) -> DataFrame:
    """ref_id, id, error: what was committed (ref_id, id, assertion_hash, action, decided_confidence, visibility) against what
    was asked for (the same columns): assertions on one side alone, other material, another action, confidence or visibility."""
    c = committed.select("ref_id", "id", *(F.col(x).alias(f"c_{x}") for x in ("assertion_hash", "action", "decided_confidence", "visibility")))
    d = request.join(c, ["ref_id", "id"], "full_outer")
    error = F.when(F.col("c_assertion_hash").isNull(), "not_committed").when(F.col("assertion_hash").isNull(), "not_requested")
    for name, what in (("assertion_hash", "material"), ("action", "action"), ("decided_confidence", "confidence"), ("visibility", "visibility")):
        error = error.when(~F.col(name).eqNullSafe(F.col(f"c_{name}")), what)
    return d.select("ref_id", "id", error.alias("error")).where("error is not null")
