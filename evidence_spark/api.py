"""The engine's four services and what stands around them, each a thin composition of operators over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, Config
from .operators import curation, evidence, guard, hybrid, lifecycle, tasks
from .sources import codec
from .sources.store import Committed, Store
from .tables import written


@dataclass
class Engine:
    """Where the inputs are. Tables that are None make the parts that need them report unavailable, never succeed."""

    spark: SparkSession
    chunks: DataFrame | None = None
    vectors: DataFrame | None = None
    existing: DataFrame | None = None
    rules: DataFrame | None = None
    ref_metadata: DataFrame | None = None
    locators: DataFrame | None = None
    violations: DataFrame | None = None
    store: Store | None = None
    config: Config = DEFAULT

    def health(self) -> dict[str, str]:
        return {name: "ready" if getattr(self, name) is not None else "unavailable" for name in ("chunks", "vectors", "existing", "ref_metadata", "store")}

    def _need(self, name: str):
        value = getattr(self, name)
        if value is None:
            raise RuntimeError(f"{name} unavailable")
        return value

    # --- curation ------------------------------------------------------------------------------------------------------

    def curate(self, documents: DataFrame, assertions: DataFrame) -> curation.Curation:
        return curation.curate(documents, assertions, self._need("existing"), self.rules, self.config)

    def curate_json(self, documents: DataFrame, rows: DataFrame) -> tuple[curation.Curation, DataFrame]:
        """Curate assertions given as JSON (ref_id, json); also the refused rows."""
        good, bad = codec.decode_assertions(rows)
        return self.curate(documents, good), bad

    def curate_and_commit(self, documents: DataFrame, assertions: DataFrame, fingerprints: dict[str, str]) -> dict[str, Committed | str]:
        """Curate, then commit each named document (ref_id -> fingerprint) that may be published; else the reason."""
        done, store = self.curate(documents, assertions), self._need("store")
        named = self.spark.createDataFrame(list(fingerprints.items()), "ref_id string, fingerprint string")
        gate = written(named.join(curation.commit_eligibility(done.reports), "ref_id", "left").withColumn("reason", F.when(F.col("publishable").isNull(), "unknown_document").otherwise(F.col("reason"))), "gate")
        committed = store.commit_all(gate.where("publishable").select("ref_id", "fingerprint"), written(curation.admit(done.decisions, assertions), "admitted"))
        out: dict[str, Committed | str] = {r.ref_id: r.reason for r in gate.where("reason is not null").collect()}
        return out | {r.ref_id: Committed(r.status, r.version_id, r.snapshot_id) for r in committed.collect()}

    # --- retrieval and guard -------------------------------------------------------------------------------------------

    def retrieve(self, queries: DataFrame, vector_queries: DataFrame | None = None, allowed: DataFrame | None = None, eligible: DataFrame | None = None, top_k: int = 5, coarse_top_k: int = 10, synonyms: DataFrame | None = None, reranker=None) -> hybrid.Retrieval:
        """Hits of queries (query_id, text). eligible: visible references (ref_id); the others are never returned."""
        chunks = self._need("chunks")
        return hybrid.hybrid_retrieve(queries, chunks, self.vectors if vector_queries is not None else None, vector_queries, None, allowed, coarse_top_k, top_k, config=self.config, visible=eligible, synonyms=synonyms, reranker=reranker)

    def visibility(self, at_version_id: str | None = None) -> tuple[DataFrame, DataFrame] | tuple[None, None]:
        """(ref_id of visible documents, assertion_id of hidden assertions) as of a version, by default the current one; nothing is
        hidden without a store or a version."""
        at = at_version_id or (self.store.current() if self.store else None)
        if at is None:
            return None, None
        store, chunks = self._need("store"), self._need("chunks")
        asked, versions = self.spark.createDataFrame([(at,)], "version_id string"), store.table("versions")
        if versions.where(F.col("version_id") == at).isEmpty():
            raise ValueError(f"no published version {at}")
        docs = lifecycle.state_as_of(store.table("lifecycle"), versions, asked)
        own = lifecycle.state_as_of(store.table("assertion_lifecycle").withColumn("reason", F.lit(None).cast("string")), versions, asked, "assertion_id")
        return lifecycle.eligibility(chunks, docs).where("visible").select("ref_id"), own.where("status in ('archived', 'superseded')").select("assertion_id")

    def evidence(self, requests: DataFrame, at_version_id: str | None = None, embed=None, synonyms: DataFrame | None = None, reranker=None) -> evidence.Evidence:
        """Evidence for requests (see evidence.retrieve) from what is visible as of a version."""
        chunks = self._need("chunks")
        visible, hidden = self.visibility(at_version_id)
        if hidden is not None and "assertion_id" not in chunks.columns:
            if not hidden.isEmpty():
                raise ValueError("to hide assertions, chunks must name theirs in assertion_id")
            hidden = None
        return evidence.retrieve(requests, chunks, vectors=self.vectors if embed else None, embed=embed, visible=visible, hidden=hidden, config=self.config, synonyms=synonyms, reranker=reranker)

    def records(self, hits: DataFrame) -> DataFrame:
        return guard.normalize_hits(hits, self._need("chunks"), config=self.config)

    def validate(self, claims: DataFrame, records: DataFrame, keys: DataFrame) -> dict[str, DataFrame]:
        """Policy, abstention and findings of claims bound to retrieved records; keys: bundle_id, coverage_key, query_id."""
        anchors = guard.bind_anchors(claims, records)
        policies = guard.claim_policy(claims, anchors)
        covered = guard.coverage(keys, records).join(keys, ["bundle_id", "coverage_key"]).where("covered").select("query_id", "coverage_key")
        refs = records.select("ref_id").distinct()
        metadata = self.ref_metadata if self.ref_metadata is not None else refs.select("ref_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("doi"))
        return {
            "policy": policies.drop("strongest"), "abstain": guard.claim_abstain(claims, policies, covered, self.config), "h1": guard.hallucination_h1(claims, anchors, metadata, self.locators),
            "h2": guard.hallucination_h2(claims, anchors, metadata), "h2_status": guard.h2_status(claims, metadata, records), "h3": guard.hallucination_h3(claims, self.violations),
        }

    def answer(self, queries: DataFrame) -> DataFrame:
        return guard.answer(self.records(self.retrieve(queries).hits), queries)

    # --- tasks ---------------------------------------------------------------------------------------------------------

    def plan(self, texts: DataFrame) -> DataFrame:
        """Steps of tasks (task_id, text)."""
        return tasks.plan(tasks.classify(texts))
