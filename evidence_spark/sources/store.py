"""Versioned tables in a folder: staged commits, snapshots, a version pointer, lifecycle records and publications.

Readers see a commit only once its version is in `versions` and the pointer log names it. Documents are committed in sets, in
a fixed number of jobs whatever their number. Each step is idempotent, so a run that was cut short is repeated from its start
and does over only what is not there yet. One writer at a time is assumed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import curation, lifecycle
from ..tables import delete, local, new_path, written

SCHEMAS = {
    "commits": "commit_id string, ref_id string, fingerprint string, phase string, batch_id string, snapshot_id string, version_id string, error string, seq long",
    "snapshots": "snapshot_id string, ref_id string, fingerprint string, content_hash string, n_assertions long, batch_id string",
    "versions": "version_id string, snapshot_id string, ref_id string, prior_version_id string, seq long",
    "pointer": "version_id string, seq long",
    "lifecycle": "lifecycle_id string, ref_id string, status string, reason string, effective_version_id string, created_seq long",
    "assertion_lifecycle": "assertion_id string, ref_id string, status string, superseded_by string, lifecycle_id string, effective_version_id string, created_seq long",
    "outbox": "event_id string, event_type string, ref_id string, old_version_id string, new_version_id string, lifecycle_id string, created_seq long",
    "publications": "publication_id string, package_id string, material_hash string, phase string, version_id string, lifecycle_id string, seq long",
}
#: Phases of a publication and of a commit, in order.
PHASES = ("prepared", "target_published", "lifecycle_published", "finalized")
COMMIT_PHASES = ("structural_committed", "vector_pending", "vector_committed", "snapshot_created", "published")
RESULT = "ref_id string, fingerprint string, status string, version_id string, snapshot_id string"

shared_path = new_path


class ConflictError(ValueError):
    """The same identity with other material."""


@dataclass
class Committed:
    status: str
    version_id: str | None
    snapshot_id: str | None


class Store:
    def __init__(self, spark: SparkSession, path: str, fail_at: str | None = None):
        self.spark, self.path, self.fail_at = spark, path, fail_at

    # --- tables --------------------------------------------------------------------------------------------------------

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def table(self, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(SCHEMAS[name]).parquet(path) if self._exists(path) else local(self.spark, [], SCHEMAS[name])

    def append(self, name: str, rows: list[tuple] | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else local(self.spark, rows, SCHEMAS[name])
        df.write.mode("append").parquet(f"{self.path}/{name}")

    def _step(self, name: str) -> None:
        if self.fail_at == name:
            self.fail_at = None
            raise RuntimeError(f"failure injected before {name}")

    def _next(self, name: str, column: str = "seq") -> int:
        return (self.table(name).agg(F.max(column)).first()[0] or 0) + 1

    # --- commits -------------------------------------------------------------------------------------------------------

    def commit_states(self) -> DataFrame:
        """The last phase of each commit and what it amounts to: commit_id, ref_id, fingerprint, phase, batch_id, snapshot_id,
        version_id, error, status (published, pending_vector or pending_finalize)."""
        last = F.max_by(F.struct("ref_id", "fingerprint", "phase", "batch_id", "snapshot_id", "version_id", "error"), "seq")
        status = F.when(F.col("x.phase") == "published", "published").when(F.col("x.phase").isin("vector_committed", "snapshot_created"), "pending_finalize").otherwise("pending_vector")
        return self.table("commits").groupBy("commit_id").agg(last.alias("x")).select("commit_id", "x.*", status.alias("status"))

    def _log(self, todo: DataFrame, phase: str, batch: str, made: DataFrame | None = None) -> None:
        have = [*todo.columns, *(made.columns if made is not None else ())]
        d = todo.join(made, "ref_id") if made is not None else todo
        d = d.select("*", *(F.lit(None).cast("string").alias(c) for c in ("snapshot_id", "version_id", "error") if c not in have))
        self.append("commits", d.select("commit_id", "ref_id", "fingerprint", F.lit(phase).alias("phase"), F.lit(batch).alias("batch_id"), "snapshot_id", "version_id", "error", F.lit(self._next("commits")).cast("long").alias("seq")))

    def commit_all(self, sources: DataFrame, admitted: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """ref_id, fingerprint, status, version_id, snapshot_id for each document of sources (ref_id, fingerprint). admitted: their
        assertions. Two fingerprints of one document in a call are a ConflictError, before anything is written.

        Structure, document records, vectors, snapshots, versions in the order of ref_id, pointer: the stages of all documents
        go together. The same source again is an idempotent_hit; a document without an assertion is nothing_admitted and leaves
        no trace. embed(rows) adds vectors to the rows that name them (vector_id, ref_id, assertion_id, content_hash, and what
        admitted has). It may add a column error: documents with a row where it is not null stay pending_vector, with the error
        in their commit, while the others are published. Where it fails as a whole, all stay pending_vector. The same call again
        goes on from there. Any other failure is raised; commit_states() then tells how far each document came.
        """
        sources = sources.select("ref_id", "fingerprint").distinct()
        if not sources.groupBy("ref_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise ConflictError("a document with two fingerprints in one commit")
        asked = sources.withColumn("commit_id", F.substring(hashing.canonical_hash(F.col("ref_id"), F.col("fingerprint")), 1, 16))
        asked = asked.join(self.commit_states().select("commit_id", "phase", "snapshot_id", "version_id"), "commit_id", "left")
        some = admitted.select("ref_id", F.lit(True).alias("some")).distinct()
        asked = written(asked.join(some, "ref_id", "left"), "commit-requests")
        none = F.lit(None).cast("string")
        result = lambda rows, status, v=none, s=none: rows.select("ref_id", "fingerprint", F.lit(status).alias("status"), v.alias("version_id"), s.alias("snapshot_id"))
        out = result(asked.where("phase <=> 'published'"), "idempotent_hit", F.col("version_id"), F.col("snapshot_id"))
        out = out.unionByName(result(asked.where("not (phase <=> 'published') and some is null"), "nothing_admitted"))
        todo = asked.where("not (phase <=> 'published') and some").select("commit_id", "ref_id", "fingerprint")
        n, key = todo.agg(F.count("*"), hashing.set_hash(F.col("commit_id"))).first()
        if not n:
            return out
        batch = f"b-{key[:16]}"
        rows = admitted if "assertion_hash" in admitted.columns else admitted.withColumn("assertion_hash", curation.assertion_hash(admitted))
        rows = rows.join(todo, "ref_id")
        self._step("structural")
        rows.write.mode("overwrite").parquet(f"{self.path}/structural/batch={batch}")
        rows = self.spark.read.parquet(f"{self.path}/structural/batch={batch}")
        self._step("usdo")
        usdo = rows.groupBy("ref_id", "fingerprint").agg(hashing.set_hash(F.col("id")).alias("ids"))
        usdo = usdo.select(F.concat(F.lit("usdo-"), "ref_id", F.lit("-"), F.substring("fingerprint", 1, 12)).alias("record_id"), "ref_id", hashing.canonical_hash(F.col("ref_id"), F.col("fingerprint"), F.col("ids")).alias("content_hash"), F.lit("usdo_json").alias("payload_kind"))
        usdo.write.mode("overwrite").parquet(f"{self.path}/usdo/batch={batch}")
        self._log(todo, "structural_committed", batch)
        vectors = rows.withColumn("vector_id", vector_id()).withColumn("assertion_id", F.col("id")).withColumn("content_hash", F.col("assertion_hash"))
        try:
            self._step("vectors")
            made = written(embed(vectors) if embed else vectors.select("vector_id", "ref_id", "assertion_id", "content_hash"), "vectors")
        except Exception as e:  # noqa: BLE001  whatever fails in a port leaves the commits pending
            self._log(todo.withColumn("error", F.lit(f"{type(e).__name__}: {e}"[:500])), "vector_pending", batch)
            return out.unionByName(result(todo, "pending_vector"))
        if "error" in made.columns:
            failed = written(made.where("error is not null").groupBy("ref_id").agg(F.min("error").alias("error")), "failed")
            made = made.join(failed.select("ref_id"), "ref_id", "left_anti").drop("error")
            if not failed.isEmpty():
                self._log(todo.join(failed, "ref_id"), "vector_pending", batch)
                out = out.unionByName(result(todo.join(failed, "ref_id"), "pending_vector"))
                todo = written(todo.join(failed, "ref_id", "left_anti"), "commit-requests")
                rows = rows.join(failed, "ref_id", "left_anti")
        made.write.mode("overwrite").parquet(f"{self.path}/vectors/batch={batch}")
        self._log(todo, "vector_committed", batch)
        manifests = written(self._manifests(rows, self.spark.read.parquet(f"{self.path}/usdo/batch={batch}"), batch), "manifests")
        if manifests.isEmpty():
            return out
        self._step("snapshot")
        fresh = manifests.join(self.table("snapshots").select("snapshot_id"), "snapshot_id", "left_anti")
        self.append("snapshots", written(fresh, "snapshots").select(*self.table("snapshots").columns))
        self._log(todo, "snapshot_created", batch, manifests.select("ref_id", "snapshot_id"))
        self._step("publish")
        self._publish(manifests)
        made = manifests.select("ref_id", "snapshot_id").join(self.table("versions").select("snapshot_id", "version_id"), "snapshot_id")
        made = written(made, "published")
        self._step("finalize")
        self._log(todo, "published", batch, made)
        return out.unionByName(result(todo.join(made, "ref_id"), "published", F.col("version_id"), F.col("snapshot_id")))

    def _manifests(self, rows: DataFrame, usdo: DataFrame, batch: str) -> DataFrame:
        none = F.lit(None).cast("string")
        parts = [F.col(c) if c in rows.columns else none for c in ("action", "decided_confidence", "visibility")]
        per = rows.withColumn("_d", hashing.canonical_hash(F.col("id"), *parts)).groupBy("ref_id", "fingerprint").agg(
            F.count("*").alias("n_assertions"), hashing.set_hash(F.col("assertion_hash")).alias("a"), hashing.set_hash(F.col("_d")).alias("d"), hashing.set_hash(vector_id()).alias("v")
        )
        content = hashing.canonical_hash(*(F.col(c) for c in ("ref_id", "fingerprint", "a", "d", "v", "u")))
        d = per.join(usdo.select("ref_id", F.col("content_hash").alias("u")), "ref_id")
        return d.select(F.concat(F.lit("snap-"), F.substring(content, 1, 16)).alias("snapshot_id"), "ref_id", "fingerprint", content.alias("content_hash"), "n_assertions", F.lit(batch).alias("batch_id"))

    def _publish(self, snapshots: DataFrame) -> None:
        """One version for each snapshot, in the order of ref_id; the first follows the current one, so that after a rollback
        the chain branches. Then the pointer names the last. Versions that a run left without naming them are named first."""
        self._catch_up()
        known = self.table("versions")
        fresh = snapshots.join(known.select("snapshot_id"), "snapshot_id", "left_anti")
        if not fresh.isEmpty():
            first, current = self._next("versions"), self.current()
            d = lifecycle.assign_sequence(fresh.select("snapshot_id", "ref_id"), ["ref_id"], first - 1).withColumnRenamed("created_seq", "seq")
            prior = F.when(F.col("seq") == first, F.lit(current)).otherwise(version_name(F.col("seq") - 1))
            self.append("versions", d.select(version_name(F.col("seq")).alias("version_id"), "snapshot_id", "ref_id", prior.alias("prior_version_id"), "seq"))
        self._step("pointer")
        self._catch_up()

    def _catch_up(self) -> None:
        """The pointer names the last version, unless it has named that or a later one before: a rollback stays one."""
        versions = self.table("versions")
        last = versions.agg(F.max_by("version_id", "seq").alias("version_id"), F.max("seq").alias("seq")).first()
        named = versions.join(self.table("pointer").select("version_id"), "version_id", "left_semi").agg(F.max("seq")).first()[0]
        if last.seq and last.seq > (named or 0):
            self._move(last.version_id)

    def commit(self, ref_id: str, fingerprint: str, admitted: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> Committed:
        """One document."""
        source = local(self.spark, [(ref_id, fingerprint)], "ref_id string, fingerprint string")
        r = self.commit_all(source, admitted.where(F.col("ref_id") == ref_id), embed).first()
        return Committed(r.status, r.version_id, r.snapshot_id)

    def sweep(self) -> None:
        """Removes the staged files of commits that were never published: compensation for runs that nobody repeats. A batch that
        the snapshot of a published version names stays, whichever set of documents published it."""
        states = self.commit_states()
        kept = states.where("phase = 'published'").select("batch_id")
        kept = kept.unionByName(self.table("snapshots").join(self.table("versions").select("snapshot_id"), "snapshot_id", "left_semi").select("batch_id")).distinct()
        for r in self.table("commits").select("batch_id").distinct().join(kept, "batch_id", "left_anti").toLocalIterator():
            for part in ("structural", "usdo", "vectors"):
                delete(self.spark, f"{self.path}/{part}/batch={r.batch_id}")

    def _move(self, version_id: str) -> None:
        self.append("pointer", [(version_id, self._next("pointer"))])

    def current(self) -> str | None:
        return self.table("pointer").agg(F.max_by("version_id", "seq")).first()[0]

    def rollback(self, version_id: str) -> None:
        """Points at an earlier version; history stays, and an event tells of it."""
        if self.table("versions").where(F.col("version_id") == version_id).isEmpty():
            raise ValueError(f"no published version {version_id}")
        seq = self._next("outbox", "created_seq")
        self.append("outbox", [(f"ev-rollback-{seq}", "rolled_back", None, self.current(), version_id, None, seq)])
        self._move(version_id)

    def resolve(self, version_id: str | None = None) -> DataFrame:
        """Assertions of one version's snapshot; of the current version by default. A snapshot covers one document."""
        version_id = version_id or self.current()
        v = self.table("versions").where(F.col("version_id") == version_id).first()
        if v is None:
            raise ValueError(f"no published version {version_id}")
        s = self.table("snapshots").where(F.col("snapshot_id") == v.snapshot_id).first()
        return self.spark.read.parquet(f"{self.path}/structural/batch={s.batch_id}").where((F.col("ref_id") == s.ref_id) & (F.col("fingerprint") == s.fingerprint))

    def resolve_all(self, at: DataFrame | None = None) -> DataFrame:
        """version_id, snapshot_id, ref_id, part (structural, usdo or vectors), id, content_hash: what the snapshots of all versions,
        or of those of at (version_id), are made of. Versions that were rolled back are still resolved; unknown ones give no row.

        The parts are read with the batch that a snapshot names, so files of other batches are not read, and of a batch only the
        documents asked for are kept.
        """
        v = self.table("versions").select("version_id", "snapshot_id")
        v = v if at is None else v.join(at.select("version_id").distinct(), "version_id", "left_semi")
        named = written(v.join(self.table("snapshots").select("snapshot_id", "ref_id", "fingerprint", "batch_id"), "snapshot_id"), "resolved")
        out = None
        for part, id_, hash_, own in (("structural", "id", "assertion_hash", ["fingerprint"]), ("usdo", "record_id", "content_hash", []), ("vectors", "vector_id", "content_hash", [])):
            if not self._exists(f"{self.path}/{part}"):
                continue
            rows = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{part}")
            rows = rows.select("ref_id", *own, F.col("batch").cast("string").alias("batch_id"), F.lit(part).alias("part"), F.col(id_).alias("id"), F.col(hash_).alias("content_hash"))
            rows = named.join(rows, ["ref_id", "batch_id", *own]).select("version_id", "snapshot_id", "ref_id", "part", "id", "content_hash")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else named.select("version_id", "snapshot_id", "ref_id", *(F.lit("").alias(c) for c in ("part", "id", "content_hash"))).where("false")

    def knowledge_base(self, version_id: str | None = None) -> DataFrame:
        """(ref_id, snapshot_id) of the newest snapshot of each document in the version's chain."""
        at = local(self.spark, [(version_id or self.current(),)], "version_id string")
        v = self.table("versions")
        chain = lifecycle.ancestors(v.select("version_id", "prior_version_id"), at).select(F.col("ancestor_id").alias("version_id"))
        return v.join(chain, "version_id").groupBy("ref_id").agg(F.max_by("snapshot_id", "seq").alias("snapshot_id"))

    # --- idempotent append ---------------------------------------------------------------------------------------------

    def append_once(self, name: str, rows: DataFrame, key: str, material: list[str]) -> int:
        """Append rows whose key is new. A known key with equal material is skipped, with other material a ConflictError,
        as are rows that give one key different material."""
        known = self.table(name)
        rows = written(rows, "append")
        if not rows.groupBy(key).agg(F.count_distinct(hashing.packed(*(F.col(c) for c in material))).alias("n")).where("n > 1").isEmpty():
            raise ConflictError(f"{name}: rows of one {key} with different material")
        differs = F.lit(False)
        for c in material:
            differs = differs | ~F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}"))
        if not rows.alias("n").join(known.alias("k"), key).where(differs).isEmpty():
            raise ConflictError(f"{name}: a known {key} with other material")
        fresh = rows.join(known, key, "left_anti").dropDuplicates([key])
        count = fresh.count()
        if count:
            self.append(name, fresh.select(*known.columns))
        return count

    # --- lifecycle -----------------------------------------------------------------------------------------------------

    def retract(self, ref_id: str, reason: str, verified_trigger: bool) -> str:
        """A record that hides a document from the current version on, and its event. Retracting again changes nothing."""
        if not verified_trigger:
            raise PermissionError("a retraction needs a verified trigger")
        lifecycle_id = f"lc-{hashlib_id(ref_id, 'retracted', reason)}"
        seq, version = self._next("lifecycle", "created_seq"), self.current()
        one = local(self.spark, [(lifecycle_id, ref_id, "retracted", reason, version, seq)], SCHEMAS["lifecycle"])
        if self.append_once("lifecycle", one, "lifecycle_id", ["ref_id", "status", "reason"]):
            self._step("event")
        event = [(f"ev-{lifecycle_id}", "document_retracted", ref_id, version, version, lifecycle_id, self._next("outbox", "created_seq"))]
        self.append_once("outbox", local(self.spark, event, SCHEMAS["outbox"]), "event_id", ["event_type", "ref_id", "lifecycle_id"])
        return lifecycle_id

    def revise(self, ref_id: str, fingerprint: str, admitted: DataFrame, moves: DataFrame, reason: str = "revision", preprint_to_journal: bool = False) -> tuple[Committed, str]:
        """Commit a revised document, then the lifecycle records that its transitions (action, old_id, new_id) ask for."""
        done = self.commit(ref_id, fingerprint, admitted)
        before = self.table("versions").where(F.col("version_id") == done.version_id).first().prior_version_id
        lifecycle_id = f"lc-{hashlib_id(ref_id, fingerprint, reason)}"
        status = "superseded" if preprint_to_journal else "active"
        self._step("lifecycle")
        one = local(self.spark, [(lifecycle_id, ref_id, status, reason, done.version_id, self._next("lifecycle", "created_seq"))], SCHEMAS["lifecycle"])
        self.append_once("lifecycle", one, "lifecycle_id", ["ref_id", "status", "reason", "effective_version_id"])
        old = moves.where("action in ('supersede', 'archive')").select(
            F.col("old_id").alias("assertion_id"), F.lit(ref_id).alias("ref_id"), F.when(F.col("action") == "supersede", "superseded").otherwise("archived").alias("status"), F.col("new_id").alias("superseded_by"), F.lit(lifecycle_id).alias("lifecycle_id"), F.lit(done.version_id).alias("effective_version_id"), F.lit(self._next("assertion_lifecycle", "created_seq")).cast("long").alias("created_seq")
        )
        known = self.table("assertion_lifecycle").where(F.col("lifecycle_id") == lifecycle_id)
        if known.isEmpty() and not old.isEmpty():
            self.append("assertion_lifecycle", old)
        self._step("event")
        event = [(f"ev-{lifecycle_id}", "document_revised", ref_id, before, done.version_id, lifecycle_id, self._next("outbox", "created_seq"))]
        self.append_once("outbox", local(self.spark, event, SCHEMAS["outbox"]), "event_id", ["event_type", "ref_id", "lifecycle_id"])
        return done, lifecycle_id

    # --- publication ---------------------------------------------------------------------------------------------------

    def publication_phase(self, publication_id: str) -> str | None:
        last = self.table("publications").where(F.col("publication_id") == publication_id).orderBy(F.desc("seq")).first()
        return last.phase if last else None

    def _advance(self, publication_id: str, package_id: str, material: str, phase: str, version: str | None, lifecycle_id: str | None) -> None:
        now = self.publication_phase(publication_id)
        if now is None or PHASES.index(phase) > PHASES.index(now):
            self.append("publications", [(publication_id, package_id, material, phase, version, lifecycle_id, self._next("publications"))])

    def publish_revision(self, package_id: str, ref_id: str, fingerprint: str, admitted: DataFrame, moves: DataFrame, approved_scope: str | None, scope: str, preprint_to_journal: bool = False) -> str:
        """Publish an approved package in journalled steps; after a failure the same call goes on where it stopped."""
        if approved_scope is None:
            raise PermissionError("not approved")
        if approved_scope != scope:
            raise PermissionError("approved for another scope")
        publication_id, material = f"pub-{hashlib_id(package_id)}", hashlib_id(package_id, ref_id, fingerprint, scope)
        first = self.table("publications").where(F.col("publication_id") == publication_id).first()
        if first and first.material_hash != material:
            raise ConflictError("the package was published with other material")
        step = lambda phase, v=None, lc=None: self._advance(publication_id, package_id, material, phase, v, lc)
        step("prepared")
        self._step("target")
        done = self.commit(ref_id, fingerprint, admitted)
        step("target_published", done.version_id)
        done, lifecycle_id = self.revise(ref_id, fingerprint, admitted, moves, "revision", preprint_to_journal)
        step("lifecycle_published", done.version_id, lifecycle_id)
        self._step("finalized")
        step("finalized", done.version_id, lifecycle_id)
        return publication_id


def vector_id():
    """Names a vector by its document, source, assertion and content."""
    return F.concat_ws("-", F.lit("vec"), "ref_id", F.substring("fingerprint", 1, 12), "id", F.substring("assertion_hash", 1, 12))


def version_name(seq):
    s = seq.cast("string")
    return F.concat(F.lit("kbv-"), F.lpad(s, F.greatest(F.lit(4), F.length(s)), F.lit("0")))


def hashlib_id(*parts: str | None) -> str:
    import hashlib

    return hashlib.sha256("\x1f".join(p or "" for p in parts).encode()).hexdigest()[:16]
