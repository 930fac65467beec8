"""Source identity: which candidates are replays, new versions of a known work, new works or contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as T
from ..tables import discard, written


def normalized(candidates: DataFrame, title: Column | None = None) -> DataFrame:
    """Adds norm_doi, norm_title, norm_stable."""
    return candidates.select("*", T.work_doi(F.col("doi")).alias("norm_doi"), (title if title is not None else T.work_title(F.col("title"))).alias("norm_title"), T.stable_id(F.col("stable_id")).alias("norm_stable"))


def _works(registry: DataFrame, key: str, out: str) -> DataFrame:
    """Works known under each value of key, at most two of them: more cannot change the outcome."""
    rows = registry.where(F.col(key).isNotNull()).groupBy(key)
    return rows.agg(F.min("work_id").alias(f"{out}_lo"), F.max("work_id").alias(f"{out}_hi"))


EXPLICIT = ("explicit_work_id", "explicit_prior_version_id", "explicit_relation", "source_kind")
RECORD = ("source_version_id", "prior_source_version_id", "relation", "source_kind")


def _with(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in columns if c not in df.columns))


def looked_up(rows: DataFrame, table: DataFrame, key: str, apart: str = "seq") -> DataFrame:
    """rows with the columns that table, which has one row for each value of key, has for theirs. Rows without a key meet nothing: they
    are dealt out by another column, as else they would all go to one task."""
    named = F.concat(F.lit("k"), F.col(key))
    found = table.select(named.alias("_k"), *(c for c in table.columns if c != key))
    return rows.withColumn("_k", F.coalesce(named, F.concat(F.lit("n"), F.col(apart)))).join(found, "_k", "left").drop("_k")


def _brief(df: DataFrame) -> DataFrame:
    """df with a digest for the title: titles may be whole texts, and are only held against each other."""
    return df.withColumn("norm_title", F.sha2("norm_title", 256))


#: What a candidate is classified and registered by.
STATED = ("seq", "ref_id", "source_fingerprint", "norm_doi", "norm_title", "norm_stable", *EXPLICIT)


def classify_intake(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """seq, disposition, work_id, relation, conflict_reason of normalized candidates against normalized registry rows
    (ref_id, source_fingerprint, work_id, norm_* and, where lineage counts, source_version_id, prior_source_version_id,
    relation, source_kind; (ref_id, source_fingerprint) and source_version_id are unique).

    Precedence: the same ref and fingerprint is an exact replay, unless the lineage or the metadata that it states contradict
    what is known. An identifier of several works, or two identifiers of different works, conflict. Then a stated lineage
    decides (a work, a prior version or a relation other than none; see _lineage), then DOI, then stable id; a title alone asks
    for review. relation is what a stated lineage amounts to. Each lookup is an equi-join with one row for each key value; titles go
    as digests, and rows that lack a key are spread over all tasks.
    """
    c, r = _brief(_with(candidates, EXPLICIT).select(*STATED)), _brief(_with(registry, RECORD))
    known = r.select("ref_id", "source_fingerprint", *(F.col(x).alias(f"k_{x}") for x in ("work_id", "norm_doi", "norm_title", "norm_stable", "prior_source_version_id", "relation", "source_kind")))
    c = c.join(known, ["ref_id", "source_fingerprint"], "left")
    for key, out in (("norm_doi", "doi"), ("norm_stable", "sid"), ("norm_title", "ttl")):
        c = looked_up(c, _works(r, key, out), key)
    c = looked_up(c, r.select(F.col("work_id").alias("explicit_work_id"), F.lit(True).alias("work_known")).distinct(), "explicit_work_id")
    c = looked_up(c, r.select(F.col("source_version_id").alias("explicit_prior_version_id"), F.col("work_id").alias("p_work"), F.col("source_kind").alias("p_kind")), "explicit_prior_version_id")
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    result = lambda d, w, why=None, rel=None: F.struct(F.lit(d).alias("disposition"), w.alias("work_id"), (F.lit(None).cast("string") if rel is None else rel).alias("relation"), F.lit(why).cast("string").alias("conflict_reason"))
    none, work, prior, rel = F.lit(None).cast("string"), F.col("explicit_work_id"), F.col("explicit_prior_version_id"), F.col("explicit_relation")
    replay = F.col("k_work_id").isNotNull()
    k = F.col("k_work_id")
    replays = (
        ("work not found on replay", work.isNotNull() & F.col("work_known").isNull()), ("work contradicts replay", work.isNotNull() & (work != k)),
        ("prior not found on replay", prior.isNotNull() & F.col("p_work").isNull()), ("prior of another work on replay", prior.isNotNull() & (F.col("p_work") != k)),
        ("prior contradicts replay", prior.isNotNull() & ~prior.eqNullSafe(F.col("k_prior_source_version_id"))), ("relation contradicts replay", rel.isNotNull() & ~rel.eqNullSafe(F.coalesce("k_relation", F.lit("none")))),
        ("kind contradicts replay", both("source_kind", "k_source_kind")), ("material contradiction on replay", both("norm_doi", "k_norm_doi") | both("norm_stable", "k_norm_stable") | both("norm_title", "k_norm_title")),
    )
    stated = work.isNotNull() | prior.isNotNull() | (rel.isNotNull() & (rel != "none"))
    wrong, resolved, relation = _lineage()
    ladder = [
        *((replay & F.coalesce(when, F.lit(False)), result("identity_conflict", k, why)) for why, when in replays),
        (replay, result("exact_replay", k)),
        (F.col("doi_lo") != F.col("doi_hi"), result("identity_conflict", none, "doi of several works")),
        (F.col("sid_lo") != F.col("sid_hi"), result("identity_conflict", none, "stable id of several works")),
        (F.col("doi_lo") != F.col("sid_lo"), result("identity_conflict", none, "doi and stable id of different works")),
        *((stated & F.coalesce(when, F.lit(False)), result("identity_conflict", none, why)) for why, when in wrong),
        (stated, result("same_work_new_version", resolved, rel=relation)),
        (F.col("doi_lo").isNotNull(), result("same_work_new_version", F.col("doi_lo"))),
        (F.col("sid_lo").isNotNull(), result("same_work_new_version", F.col("sid_lo"))),
        (F.col("ttl_lo").isNotNull(), result("review_required", none)),
        (F.lit(True), result("new_work", none)),
    ]
    return c.select("seq", F.coalesce(*(F.when(when, out) for when, out in ladder)).alias("r")).select("seq", "r.*")


def _lineage() -> tuple[list[tuple[str, Column]], Column, Column]:
    """What is wrong with a stated lineage (first that applies), the work it names and its relation.

    A relation of none beside a work or a version contradicts itself. A relation alone names nothing. An unknown work or
    version, a version of another work, and identifiers of another work than the one named conflict. Revisions, corrections and
    steps from preprint to journal need the version before, the last also a preprint there and a journal here. Without a
    relation, a version means a revision and a work alone the same work.
    """
    work, prior, rel = F.col("explicit_work_id"), F.col("explicit_prior_version_id"), F.col("explicit_relation")
    resolved = F.coalesce(work, F.col("p_work"))
    relation = F.coalesce(rel, F.when(prior.isNotNull(), F.lit("revision_of")).otherwise(F.lit("explicit_same_work")))
    journal = relation == "preprint_to_journal"
    wrong = [
        ("none contradicts stated lineage", (rel == "none") & (work.isNotNull() | prior.isNotNull())),
        ("relation without target", work.isNull() & prior.isNull()),
        ("work not found", work.isNotNull() & F.col("work_known").isNull()),
        ("prior not found", prior.isNotNull() & F.col("p_work").isNull()),
        ("prior of another work", prior.isNotNull() & (F.col("p_work") != work)),
        ("doi of another work", F.col("doi_lo") != resolved),
        ("stable id of another work", F.col("sid_lo") != resolved),
        ("relation needs a prior", relation.isin("preprint_to_journal", "revision_of", "corrected_version") & prior.isNull()),
        ("prior is no preprint", journal & ~F.col("p_kind").eqNullSafe(F.lit("preprint"))),
        ("candidate is no journal", journal & ~F.col("source_kind").eqNullSafe(F.lit("journal"))),
    ]
    return wrong, resolved, relation


def proceed(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Registry rows of the candidates that may be registered: new works and new versions of known ones.

    A version's id comes from ref, fingerprint and work; a new work's from ref and fingerprint. An omitted relation is stored
    as a revision of a known work, or as none.
    """
    c = _with(candidates, EXPLICIT).join(decisions.where("disposition in ('new_work', 'same_work_new_version')").select("seq", "disposition", F.col("work_id").alias("named")), "seq")
    new = F.col("disposition") == "new_work"
    c = c.withColumn("work_id", F.when(new, hashing.canonical_hash(F.lit("new_work"), F.col("ref_id"), F.col("source_fingerprint"), length=16)).otherwise(F.col("named")))
    relation = F.coalesce("explicit_relation", F.when(new, F.lit("none")).otherwise(F.lit("revision_of")))
    none = F.lit(None).cast("string")
    return c.select(
        hashing.canonical_hash(F.col("ref_id"), F.col("source_fingerprint"), F.col("work_id"), length=16).alias("source_version_id"), "work_id", "ref_id", "source_fingerprint", "norm_doi", "norm_title", "norm_stable",
        "source_kind", relation.alias("relation"), F.col("explicit_prior_version_id").alias("prior_source_version_id"), none.alias("kb_version_id"), none.alias("snapshot_id"),
    )


#: What a version id that proceed() gives looks like.
OWN_ID = "^[0-9a-f]{16}$"


def _keys(rows: DataFrame, *more: Column) -> Column:
    """What a row may share with others, as digests, so that titles of any length travel as 16 bytes."""
    tagged = lambda tag, *c: F.when(F.concat(*c).isNotNull(), F.md5(hashing.packed(F.lit(tag), *c)))
    return F.array_distinct(F.array_compact(F.array(tagged("d", F.col("norm_doi")), tagged("s", F.col("norm_stable")), tagged("t", F.col("norm_title")), tagged("r", F.col("ref_id"), F.col("source_fingerprint")), *(tagged("w", c) for c in more))))


def _never_registers(c: DataFrame, registry: DataFrame) -> DataFrame:
    """c with column never: rows whose stated lineage is wrong whatever the rows before them do, or whose identifier already has
    several works. They are decided in their turn, but nothing needs to wait for them."""
    works = registry.select(F.col("work_id").alias("explicit_work_id")).distinct().unionByName(c.select(F.col("own_work").alias("explicit_work_id")).distinct()).distinct().withColumn("_w", F.lit(True))
    versions = registry.select(F.col("source_version_id").alias("explicit_prior_version_id")).distinct().withColumn("_v", F.lit(True))
    d = looked_up(looked_up(c, works, "explicit_work_id"), versions, "explicit_prior_version_id")
    for key in ("norm_doi", "norm_stable"):
        d = looked_up(d, _works(registry, key, key).where(F.col(f"{key}_lo") != F.col(f"{key}_hi")).select(key, F.lit(True).alias(f"_{key}")), key)
    work, prior, rel = F.col("explicit_work_id"), F.col("explicit_prior_version_id"), F.col("explicit_relation")
    stated = work.isNotNull() | prior.isNotNull() | (rel.isNotNull() & (rel != "none"))
    wrong = (rel == "none") | (work.isNull() & prior.isNull()) | (work.isNotNull() & F.col("_w").isNull()) | (prior.isNotNull() & F.col("_v").isNull() & ~prior.rlike(OWN_ID)) | (rel.isin("preprint_to_journal", "revision_of", "corrected_version") & prior.isNull())
    never = (stated & F.coalesce(wrong, F.lit(False))) | F.coalesce("_norm_doi", "_norm_stable", F.lit(False))
    return d.select(*c.columns, never.alias("never"), (prior.isNotNull() & F.col("_v").isNull() & prior.rlike(OWN_ID)).alias("waits"))


def _as_seen(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows, where works and versions that only rows after them registered have names that nothing has."""
    later = lambda c, key: known.groupBy(F.col(c).alias(key)).agg(F.min(F.coalesce("registered", F.lit(-(1 << 62)))).alias("_at"))
    out = rows
    for c, key in (("work_id", "explicit_work_id"), ("source_version_id", "explicit_prior_version_id")):
        out = looked_up(out, later(c, key), key).withColumn(key, F.when(F.col("_at") > F.col("seq"), F.concat(F.lit("later:"), key)).otherwise(F.col(key))).drop("_at")
    return out


def intake_in_order(candidates: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions as of classify_intake(), the grown registry) of candidates that are taken in one after the other, by seq: each is
    held against the registry and all rows before it that were registered. seq is unique.

    Rows depend on each other only through what they share: DOI, stable id, title, (ref_id, fingerprint), or a work that one
    founds and another names. Once a row with a key is registered, the key's work does not change any more. So rounds go over all
    rows at once: a row is ready when, for each of its keys, there is a registered row or no row before it still waits. Ready
    rows are classified together and registered. A DOI that a third of the rows have is settled in two rounds, as is any key; a
    row that cannot register holds up nobody. A row that names a version of this very batch waits for all rows before it.
    """
    texts = candidates.select("norm_title").unionByName(registry.select("norm_title"))
    candidates, registry = _brief(_with(candidates, EXPLICIT).select(*STATED)), _brief(registry)
    c = candidates.withColumn("own_work", hashing.canonical_hash(F.lit("new_work"), F.col("ref_id"), F.col("source_fingerprint"), length=16))
    c = written(_never_registers(c, _with(registry, RECORD)), "intake")
    rows = c.drop("own_work", "never", "waits")
    known = written(_with(registry, RECORD).select("source_version_id", "work_id", "ref_id", "source_fingerprint", "norm_doi", "norm_title", "norm_stable", "source_kind", "relation", "prior_source_version_id", F.lit(None).cast("long").alias("registered")), "registry")
    # A work's founder holds the key of the work's name for those that name it.
    own = lambda rows: F.md5(hashing.packed(F.lit("r"), F.col("ref_id"), F.col("source_fingerprint")))
    name = F.when(F.col("explicit_work_id").isNotNull(), F.md5(hashing.packed(F.lit("w"), F.col("explicit_work_id"))))
    keys = c.select("seq", "never", own(c).alias("own"), name.alias("name"), F.explode(_keys(c, F.col("explicit_work_id"), F.col("own_work"))).alias("key"))

    def left(open_: DataFrame, registered: DataFrame) -> DataFrame:
        """Keys that are still open. A row whose source is registered is a replay: it registers nothing, and only a work that it
        names still matters to it."""
        held = registered.select(F.explode(_keys(registered, F.col("work_id"))).alias("key")).distinct()
        again = registered.select(own(registered).alias("own"), F.lit(True).alias("again")).distinct()
        d = open_.join(held, "key", "left_anti").join(again, "own", "left")
        return d.where("again is null or key = name").withColumn("never", F.col("never") | F.coalesce("again", F.lit(False))).select("seq", "never", "own", "name", "key")

    open_ = written(left(keys, known), "intake-keys")
    waiting = written(c.select("seq", "never", "waits"), "intake-waiting")
    decisions = []
    while not waiting.isEmpty():
        first = open_.where("not never").groupBy("key").agg(F.min("seq").alias("first"))
        blocked = open_.join(first, "key").where("seq > first").select("seq").distinct()
        ready = waiting.join(blocked, "seq", "left_anti")
        if not ready.where("waits").isEmpty():
            least = waiting.where("not never").agg(F.min("seq")).first()[0]
            ready = ready.where(~F.col("waits") | (F.col("seq") <= (least if least is not None else 1 << 62)))
        now = written(_as_seen(rows.join(ready.select("seq"), "seq", "left_semi"), known), "intake-ready")
        done = written(classify_intake(now, known), "intake-decisions")
        at = now.groupBy("ref_id", "source_fingerprint").agg(F.min("seq").alias("registered"))
        fresh = written(proceed(now, done).drop("kb_version_id", "snapshot_id").join(at, ["ref_id", "source_fingerprint"]), "intake-registered")
        decisions.append(done)
        known = known.unionByName(fresh)
        after = written(left(open_.join(done.select("seq"), "seq", "left_anti"), fresh), "intake-keys")
        still = written(waiting.join(done.select("seq"), "seq", "left_anti"), "intake-waiting")
        discard(open_, waiting, now)
        open_, waiting = after, still
    out = decisions[0] if decisions else classify_intake(rows, known)
    for d in decisions[1:]:
        out = out.unionByName(d)
    # Titles went as digests; their texts join the registry where it is asked for them.
    digest = F.concat(F.lit("k"), F.sha2("norm_title", 256))
    full = texts.where("norm_title is not null").groupBy(digest.alias("_k")).agg(F.any_value("norm_title").alias("_text"))
    grown = known.withColumn("_k", F.coalesce(F.concat(F.lit("k"), "norm_title"), F.concat(F.lit("n"), "source_version_id"))).join(full, "_k", "left")
    return out, grown.select(*(F.col("_text").alias(x) if x == "norm_title" else F.col(x) for x in known.columns if x != "registered"))


def finalize_bind(registry: DataFrame, commits: DataFrame) -> DataFrame:
    """The registry with the published version and snapshot of its rows. commits: source_version_id, status, version_id,
    snapshot_id. Binding a row anew to something else, or on a commit that is not published, is an error."""
    b = commits.select("source_version_id", "status", F.col("version_id").alias("_v"), F.col("snapshot_id").alias("_s"))
    d = registry.join(b, "source_version_id", "left")
    bad = F.when(~F.col("status").isin("published", "idempotent_hit"), F.raise_error(F.lit("a source version binds to published commits only")))
    bad = bad.when(F.col("_v").isNotNull() & (F.col("kb_version_id") != F.col("_v")), F.raise_error(F.lit("a source version is bound to another version")))
    return d.withColumn("kb_version_id", F.coalesce(bad.cast("string"), "kb_version_id", "_v")).withColumn("snapshot_id", F.coalesce("snapshot_id", "_s")).drop("status", "_v", "_s")


def register(candidates: DataFrame) -> DataFrame:
    """A registry from a history in the order of seq, of rows with a (ref_id, fingerprint) of their own that state a DOI, or a
    stable id, or a title, but one of these alone.

    Rows of one DOI, or one stable id, are versions of the work that the first of them names. Of rows with a title alone the
    first is a work; the others ask for review and are not registered, as is a title that is not known otherwise.
    """
    key = F.coalesce(F.concat(F.lit("d"), "norm_doi"), F.concat(F.lit("s"), "norm_stable"), F.concat(F.lit("t"), "norm_title"), F.concat(F.lit("n"), "seq"))
    v = _with(candidates, EXPLICIT).withColumn("_k", key)
    first = v.groupBy("_k").agg(F.min("seq").alias("_first"))
    v = v.join(first, "_k").where(F.col("norm_doi").isNotNull() | F.col("norm_stable").isNotNull() | (F.col("seq") == F.col("_first"))).drop("_k")
    return v.withColumn("work_id", F.concat(F.lit("W-"), "_first")).withColumn("source_version_id", F.concat(F.lit("SV-"), "seq")).withColumn("relation", F.when(F.col("seq") == F.col("_first"), "none").otherwise("revision_of")).drop("_first")
