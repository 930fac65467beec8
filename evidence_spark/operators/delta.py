"""Version deltas: alignment of content units, carried assertions and transitions between two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing


def align_units(prior: DataFrame, new: DataFrame) -> DataFrame:
    """pair_id, prior_unit, unit, category of units (pair_id, unit_id, content_hash[, prior_unit_id]).

    A new unit belongs to the prior unit that it names, else to the one of the same id. What finds no partner is added or
    removed. Two new units with one partner are an error (see alignment_errors).
    """
    n = new.select("pair_id", F.coalesce("prior_unit_id", "unit_id").alias("k"), F.col("unit_id").alias("unit"), F.col("content_hash").alias("new_hash"))
    p = prior.select("pair_id", F.col("unit_id").alias("k"), F.col("unit_id").alias("prior_unit"), F.col("content_hash").alias("old_hash"))
    a = n.join(p, ["pair_id", "k"], "full_outer")
    category = F.when(F.col("prior_unit").isNull(), "added").when(F.col("unit").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    return a.select("pair_id", "prior_unit", "unit", category.alias("category"))


def alignment_errors(prior: DataFrame, new: DataFrame) -> DataFrame:
    """pair_id, unit, error: units that a version lists twice, prior units that two new ones claim, claims of unknown prior
    units. A pair with an error has no alignment: valid_pairs() leaves it out."""
    twice = lambda df, e: df.groupBy("pair_id", F.col("unit_id").alias("unit")).agg(F.count("*").alias("n")).where("n > 1").select("pair_id", "unit", F.lit(e).alias("error"))
    claims = new.select("pair_id", F.coalesce("prior_unit_id", "unit_id").alias("unit"), F.col("prior_unit_id").isNotNull().alias("named"))
    known = prior.select("pair_id", F.col("unit_id").alias("unit")).distinct()
    claimed = claims.join(known, ["pair_id", "unit"], "left_semi").groupBy("pair_id", "unit").agg(F.count("*").alias("n")).where("n > 1").select("pair_id", "unit", F.lit("claimed_twice").alias("error"))
    unknown = claims.where("named").join(known, ["pair_id", "unit"], "left_anti").select("pair_id", "unit", F.lit("unknown_prior").alias("error")).distinct()
    return claimed.unionByName(unknown).unionByName(twice(prior, "repeated_prior")).unionByName(twice(new, "repeated_unit"))


def valid_pairs(aligned: DataFrame, errors: DataFrame) -> DataFrame:
    """The alignment of pairs without an error."""
    return aligned.join(errors.select("pair_id").distinct(), "pair_id", "left_anti")


def unsafe_pairs(prior: DataFrame, inventory: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """pair_id, reason of pairs whose delta can't be trusted: upstream cut the text into units anew (resets: pair_id), or an
    assertion of the prior inventory (pair_id, unit_id) belongs to a unit that the prior version doesn't list."""
    lost = inventory.join(prior.select("pair_id", "unit_id").distinct(), ["pair_id", "unit_id"], "left_anti").select("pair_id").distinct()
    out = lost.select("pair_id", F.lit("unresolved_unit").alias("reason"))
    if resets is not None:
        declared = resets.select("pair_id").distinct()
        out = out.join(declared, "pair_id", "left_anti").unionByName(declared.select("pair_id", F.lit("segmentation_reset").alias("reason")))
    return out


def delta_plan(aligned: DataFrame, unsafe: DataFrame | None = None) -> DataFrame:
    """pair_id, counts of categories, mode, reason, and the units to extract anew (sorted).

    A safe delta extracts modified and added units. A pair in unsafe (pair_id, reason) has all of its new units extracted and
    no alignment to count; nothing else asks for that, not even a pair of which nothing aligns.
    """
    n = lambda c: F.count_if((F.col("category") == c) & F.col("reason").isNull()).alias(f"n_{c}")
    extract = F.array_sort(F.collect_list(F.when(F.col("category").isin("modified", "added") | F.col("reason").isNotNull(), F.col("unit"))))
    d = aligned.join(unsafe, "pair_id", "left") if unsafe is not None else aligned.withColumn("reason", F.lit(None).cast("string"))
    plan = d.groupBy("pair_id", "reason").agg(n("unchanged"), n("modified"), n("added"), n("removed"), extract.alias("extract"))
    mode = F.when(F.col("reason").isNotNull(), "full_reextract_required").otherwise("delta_safe")
    return plan.select("pair_id", "n_unchanged", "n_modified", "n_added", "n_removed", mode.alias("mode"), "reason", "extract")


def extraction_requests(plan: DataFrame, new: DataFrame) -> DataFrame:
    """pair_id, unit_id, locator, reason: what upstream is asked to extract. new: units with their locator."""
    asked = plan.select("pair_id", F.explode("extract").alias("unit_id"), F.when(F.col("mode") == "delta_safe", "changed_or_added_units_only").otherwise("full_reextract_required").alias("reason"))
    return asked.join(new.select("pair_id", "unit_id", "locator"), ["pair_id", "unit_id"])


def batch_errors(batch: DataFrame, processed: DataFrame, plan: DataFrame, new: DataFrame) -> DataFrame:
    """pair_id, id, error of an extracted batch (pair_id, unit_id, assertion_id) and the units said to be processed
    (pair_id, unit_id): ids given twice, assertions without a unit, of unknown units or of units not processed, and pairs whose
    processed units are not those that the plan asks for."""
    units = new.select("pair_id", "unit_id").distinct()
    done = processed.select("pair_id", "unit_id").distinct()
    of = lambda df, e: df.select("pair_id", F.col("assertion_id").alias("id"), F.lit(e).alias("error"))
    bound = batch.where("unit_id is not null")
    twice = batch.groupBy("pair_id", "assertion_id").agg(F.count("*").alias("n")).where("n > 1")
    out = of(twice, "repeated_id").unionByName(of(batch.where("unit_id is null"), "no_unit")).unionByName(of(bound.join(units, ["pair_id", "unit_id"], "left_anti"), "unknown_unit"))
    out = out.unionByName(of(bound.join(units, ["pair_id", "unit_id"], "left_semi").join(done, ["pair_id", "unit_id"], "left_anti"), "unit_not_processed"))
    asked = plan.select("pair_id", F.explode("extract").alias("unit_id"))
    differs = asked.join(done, ["pair_id", "unit_id"], "left_anti").unionByName(done.join(plan.select("pair_id"), "pair_id", "left_semi").join(asked, ["pair_id", "unit_id"], "left_anti"))
    return out.unionByName(differs.select("pair_id", F.col("unit_id").alias("id"), F.lit("processed_differs_from_plan").alias("error")))


def carry_forward(aligned: DataFrame, prior_assertions: DataFrame) -> DataFrame:
    """Assertions of unchanged units, under their unit of the new version and with an id of their own."""
    same = aligned.where("category = 'unchanged'").select("pair_id", F.col("prior_unit").alias("unit_id"), "unit")
    a = prior_assertions.join(same, ["pair_id", "unit_id"])
    new_id = F.concat(F.col("assertion_id"), F.lit("@"), F.substring(F.sha2(F.concat_ws("|", "pair_id", "unit", "assertion_id"), 256), 1, 12))
    return a.select("pair_id", "unit", "assertion_id", new_id.alias("carried_id"), "slot_key", "payload_hash")


def transitions(aligned: DataFrame, prior: DataFrame, new: DataFrame, plan: DataFrame) -> DataFrame:
    """pair_id, action, old_id, new_id, reason: what happens to each assertion.

    Carried assertions supersede their former selves. In a modified unit, equal slots supersede, lone prior ones are
    archived, lone new ones added; a unit in which either side fills a slot twice asks for review as a whole, in one row
    without ids. Assertions of removed units are archived, those of added units added. Where all must be extracted anew, all
    prior ones are archived and all new added. Pairs without a plan have no rows.
    """
    a, none = F.col("assertion_id"), F.lit(None).cast("string")
    modes = plan.select("pair_id", F.col("mode") == "full_reextract_required").toDF("pair_id", "full")

    def side(assertions: DataFrame, unit: str, old: bool) -> DataFrame:
        """The assertions of one side with their unit of the new version and what became of it; one join with the alignment."""
        units = aligned.select("pair_id", F.col(unit).alias("unit_id"), "unit", "category").where("unit_id is not null").dropDuplicates(["pair_id", "unit_id"])
        d = assertions.join(modes, "pair_id").join(units, ["pair_id", "unit_id"], "left")
        kind = F.when(F.col("full"), "full").when(F.col("category") == "modified", "modified").when(F.col("category").isin(*(("unchanged", "removed") if old else ("added",))), F.col("category"))
        d = d.select("pair_id", "unit", "slot_key", kind.alias("kind"), (a if old else none).alias("old"), (none if old else a).alias("new"))
        # In a modified unit a slot is one row, elsewhere an assertion is.
        return d.where("kind is not null").withColumn("slot", F.when(F.col("kind") == "modified", F.col("slot_key")).otherwise(F.coalesce("old", "new")))

    rows = side(prior, "prior_unit", True).unionByName(side(new, "unit", False))
    ids = [F.count("old").alias("n_old"), F.count("new").alias("n_new"), F.min("old").alias("old_id"), F.min("new").alias("new_id")]
    slots = rows.groupBy("pair_id", "kind", "unit", "slot", F.when(F.col("kind") != "modified", F.coalesce("old", "new")).alias("one"), F.when(F.col("kind") != "modified", F.col("old").isNotNull()).alias("is_old")).agg(*ids)
    unit = Window.partitionBy("pair_id", "kind", "unit", "one")  # a modified unit's slots; all other rows stand alone
    modified = F.col("kind") == "modified"
    most = F.when(modified, F.max(F.greatest("n_old", "n_new")).over(unit)).otherwise(1)
    d = slots.select("*", most.alias("most"), F.when(modified, F.row_number().over(unit.orderBy("slot"))).otherwise(1).alias("nth")).where("most <= 1 or nth = 1")
    carried = F.concat(F.col("old_id"), F.lit("@"), F.substring(F.sha2(F.concat_ws("|", "pair_id", "unit", "old_id"), 256), 1, 12))
    move = lambda action, old, new_, why: F.struct(F.lit(action).alias("action"), old.alias("old_id"), new_.alias("new_id"), F.lit(why).alias("reason"))
    gone, came = F.col("new_id").isNull(), F.col("old_id").isNull()
    o, n = F.col("old_id"), F.col("new_id")
    moved = (
        F.when(F.col("most") > 1, move("review_required", none, none, "duplicate_slot")).when(F.col("kind") == "unchanged", move("supersede", o, carried, "unchanged_unit_carry_forward"))
        .when(F.col("kind") == "removed", move("archive", o, none, "removed_unit")).when(F.col("kind") == "added", move("added", none, n, "added_unit"))
        .when(modified & gone, move("archive", o, none, "modified_unit_old_slot_unmatched")).when(modified & came, move("added", none, n, "modified_unit_new_slot_unmatched")).when(modified, move("supersede", o, n, "modified_unit_slot_match"))
        .when(gone, move("archive", o, none, "full_reextract_prior_archived")).otherwise(move("added", none, n, "full_reextract_new_added"))
    )
    times = F.when(modified, 1).otherwise(F.col("n_old") + F.col("n_new")).cast("int")  # rows that repeat an id stay rows of their own
    return d.select("pair_id", F.explode(F.array_repeat(moved, times)).alias("m")).select("pair_id", "m.*")


def revision_actions(moves: DataFrame) -> DataFrame:
    """pair_id, affected and replacement ids (sorted), counts: what a revision package says of its assertions."""
    old = F.when(F.col("action").isin("supersede", "archive"), F.col("old_id"))
    new = F.when(F.col("action").isin("supersede", "added"), F.col("new_id"))
    count = lambda a: F.count_if(F.col("action") == a).alias(f"n_{a}")
    g = moves.groupBy("pair_id").agg(F.collect_set(old).alias("o"), F.collect_set(new).alias("n"), F.collect_set(F.when(F.col("action") == "added", F.col("new_id"))).alias("x"), count("supersede"), count("archive"), count("added"), count("review_required"))
    return g.select("pair_id", F.array_join(F.array_sort(F.array_union("o", "x")), ",").alias("affected"), F.array_join(F.array_sort("n"), ",").alias("replacement"), "n_supersede", "n_archive", "n_added", "n_review_required", (F.col("n_review_required") > 0).alias("needs_review"))


#: Lifecycle reason of a package, by its relation; any other relation is a correction by hand.
REASONS = {"preprint_to_journal": "preprint_to_journal"}


def packages(intents: DataFrame, versions: DataFrame) -> DataFrame:
    """package_id, pair_id, prior_ref, new_ref, lifecycle_reason, error of intents (pair_id, work_id, prior_id, new_id, relation).

    versions: source_version_id, work_id, ref_id, relation, prior_source_version_id, source_kind, source_fingerprint,
    kb_version_id, snapshot_id. The error is the first check that fails, and a package with one has no id.
    """
    side = lambda p: versions.select(*(F.col(c).alias(f"{p}_{c}") for c in versions.columns))
    d = intents.join(side("p"), F.col("prior_id") == F.col("p_source_version_id"), "left").join(side("n"), F.col("new_id") == F.col("n_source_version_id"), "left")
    works = versions.select(F.col("work_id").alias("w")).distinct()
    d = d.join(works, F.col("work_id") == F.col("w"), "left")
    p2j = F.col("relation") == "preprint_to_journal"
    checks = (
        ("unknown_work", F.col("w").isNotNull()), ("unknown_prior", F.col("p_source_version_id").isNotNull()), ("unknown_new", F.col("n_source_version_id").isNotNull()),
        ("other_work", (F.col("p_work_id") == F.col("work_id")) & (F.col("n_work_id") == F.col("work_id"))), ("other_prior", F.col("n_prior_source_version_id").eqNullSafe(F.col("prior_id"))),
        ("other_relation", F.col("n_relation").eqNullSafe(F.col("relation"))), ("prior_unbound", (F.coalesce("p_kb_version_id", F.lit("")) != "") & (F.coalesce("p_snapshot_id", F.lit("")) != "")),
        ("prior_not_preprint", ~p2j | (F.col("p_source_kind") == "preprint")), ("new_not_journal", ~p2j | (F.col("n_source_kind") == "journal")),
    )
    error = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))
    material = ("work_id", "prior_id", "new_id", "relation", "p_ref_id", "n_ref_id", "p_source_fingerprint", "n_source_fingerprint", "p_kb_version_id", "p_snapshot_id")
    ident = F.when(error.isNull(), hashing.canonical_hash(*(F.col(c) for c in material), length=16))
    reason = F.lit("manual_correction")
    for relation, name in REASONS.items():
        reason = F.when(F.col("relation") == relation, F.lit(name)).otherwise(reason)
    return d.select("pair_id", ident.alias("package_id"), F.col("p_ref_id").alias("prior_ref"), F.col("n_ref_id").alias("new_ref"), reason.alias("lifecycle_reason"), error.alias("error"))
