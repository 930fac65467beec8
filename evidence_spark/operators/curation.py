"""Curation: completeness, conflicts, mechanism rules, quality, decisions and reports, for many documents at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, NUMERIC_TYPES, TEXT_TYPES, Config
from ..functions import hashing, intervals
from ..tables import written
from .sweep import Step, in_tasks, spread

ISSUES = ("metadata_incomplete", "no_assertions", "missing_units", "missing_locators", "chart_quality_low", "parsed_doc_manual_review", "parsed_doc_not_formal")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def unit_missing() -> Column:
    """A numeric assertion without a unit; the flag counts for numeric ones alone here."""
    return F.col("value_type").isin(*NUMERIC_TYPES) & (F.coalesce("missing_unit", F.lit(False)) | blank(F.col("unit")))


def locator_missing() -> Column:
    return F.coalesce(F.col("locator"), F.lit("")) == ""


def completeness(documents: DataFrame, assertions: DataFrame) -> DataFrame:
    """One row for each document: status, issues (codes) and what may happen to it next.

    The status is the first that applies of: metadata_incomplete, parsed_doc_not_formal (grades D, E), explicit_no_data,
    no_assertions, missing_units, manual_review (grade C), missing_locators, chart_quality_low, ok.
    """
    per_doc = assertions.groupBy("ref_id").agg(F.count("*").alias("assertion_count"), F.count_if(unit_missing()).alias("units_missing"), F.count_if(locator_missing()).alias("locators_missing"))
    d = documents.join(per_doc, "ref_id", "left").fillna(0, ["assertion_count", "units_missing", "locators_missing"])
    m, grade = F.col("metadata"), F.col("quality_grade")
    lacking = (F.coalesce(m["title"], F.lit("")) == "") | (F.coalesce(F.size(m["authors"]), F.lit(0)) <= 0) | m["year"].isNull() | (F.coalesce(m["source"], F.lit("")) == "")
    lacking = lacking | ((F.coalesce(m["doi"], F.lit("")) == "") & (F.coalesce(m["stable_id"], F.lit("")) == ""))
    charts_low = F.exists(F.coalesce("charts", F.array()), lambda c: c["not_digitizable"] | c["quality_low"] | ~(c["caption_complete"] & c["axes_complete"] & c["units_complete"]))
    none = F.col("assertion_count") == 0
    d = d.select("*", lacking.alias("lacking"), charts_low.alias("charts_low"), grade.isin("D", "E").alias("excluded"), (grade == "C").alias("manual"))
    found = dict(zip(ISSUES, ("lacking", none & ~F.col("no_structured_data"), F.col("units_missing") > 0, F.col("locators_missing") > 0, "charts_low", "manual", "excluded"), strict=True))
    issues = F.array_compact(F.array(*(F.when(F.col(c) if isinstance(c, str) else c, F.lit(code)) for code, c in found.items())))
    status = (
        F.when(F.col("lacking"), "metadata_incomplete").when(F.col("excluded"), "parsed_doc_not_formal").when(none & F.col("no_structured_data"), "explicit_no_data").when(none, "no_assertions")
        .when(F.col("units_missing") > 0, "missing_units").when(F.col("manual"), "manual_review").when(F.col("locators_missing") > 0, "missing_locators").when(F.col("charts_low"), "chart_quality_low")
        .when(grade.isin("A", "B"), "ok").otherwise("manual_review")
    )
    d = d.select("ref_id", "assertion_count", "units_missing", "locators_missing", "charts_low", issues.alias("issues"), status.alias("status"), "no_structured_data", "manual", "excluded")
    upstream = F.col("status") == "metadata_incomplete"
    return d.select(
        "ref_id", "status", "assertion_count", "units_missing", "locators_missing", "charts_low", "issues",
        (~F.col("excluded") & ~upstream & ~((F.col("assertion_count") == 0) & ~F.col("no_structured_data"))).alias("allows_formal"),
        (F.col("manual") | (F.col("units_missing") > 0)).alias("requires_manual_review"),
        upstream.alias("requires_return_upstream"),
    )


def _comparable(a: DataFrame, side: str) -> DataFrame:
    low, high = intervals.interval(F.col("value_type"), F.col("value_num"), F.col("value_lo"), F.col("value_hi"), F.col("uncertainty"))
    last = F.map_from_entries(F.transform("conditions", lambda c: F.struct(F.lower(c["eddo_class"]), F.struct(c["value"].alias("v"), c["unit"].alias("u")))))
    cols = {"id": F.col("id"), "ref": F.col("ref_id"), "type": F.col("value_type"), "num": F.col("value_num"), "text": F.col("value_text"), "low": low, "high": high, "cond": F.coalesce(parsed_conditions(F.array_sort(F.map_entries(last))), F.array())}
    return a.select("entity", "property", *(c.alias(f"{side}_{k}") for k, c in cols.items()))


def parsed_conditions(entries: Column) -> Column:
    """Entries (class, (value, unit)) with their value as a number, where it is one, and as trimmed lower-case text: read once
    for each assertion, not for each pair."""

    def one(e: Column) -> Column:
        v = F.trim(e["value"]["v"])
        number = F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v.try_cast("double"))
        return F.struct(e["key"].alias("k"), e["value"]["u"].alias("u"), number.alias("n"), F.lower(v).alias("t"))

    return F.transform(entries, one)


def conditions_compatible(a: Column, b: Column) -> Column:
    """Of parsed conditions sorted by class: equal classes and units; values equal as numbers within 1e-9, else as text."""

    def same(x: Column, y: Column) -> Column:
        value = F.when(x["n"].isNotNull() & y["n"].isNotNull(), F.abs(x["n"] - y["n"]) <= 1e-9).otherwise(x["t"].eqNullSafe(y["t"]))
        return (x["k"] == y["k"]) & x["u"].eqNullSafe(y["u"]) & value

    return a.eqNullSafe(b) | ((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: same(x, y)), lambda ok: ok))


def conflicts(new: DataFrame, existing: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """new_id, existing_id, new_ref, conflict_type of pairs on the same entity and property from different documents.

    Conditions are looked at first: different ones make a condition_difference whatever the values are. Texts and enums are
    then compared as they are, numbers as intervals, where only the existing side gets a tolerance. Pairs with a formula or
    without a number are dropped. The join is on (entity, property); Spark splits a hot entity's partition.
    """
    p = _comparable(new, "n").join(_comparable(existing, "e"), ["entity", "property"]).where("n_ref != e_ref")
    textual = F.col("n_type").isin(*TEXT_TYPES) | F.col("e_type").isin(*TEXT_TYPES)
    equal = intervals.scalar_equal(F.col("n_num"), F.col("e_num"), F.coalesce("n_text", F.col("n_num").cast("string")), F.coalesce("e_text", F.col("e_num").cast("string")))
    overlap = intervals.intervals_compatible((F.col("n_low"), F.col("n_high")), (F.col("e_low"), F.col("e_high")), config)
    kind = (
        F.when(~conditions_compatible(F.col("n_cond"), F.col("e_cond")), "condition_difference")
        .when(textual, F.when(equal, "consistent").otherwise("relation_conflict"))
        .when((F.col("n_type") == "formula") | (F.col("e_type") == "formula") | F.col("n_low").isNull() | F.col("e_low").isNull(), None)
        .when(overlap, "consistent")
        .otherwise("numeric_conflict")
    )
    return p.select(F.col("n_id").alias("new_id"), F.col("e_id").alias("existing_id"), F.col("n_ref").alias("new_ref"), kind.alias("conflict_type")).where("conflict_type is not null")


#: Assertions of one entity and property that a task may sort; more are spread over several.
TASK_ROWS = 1_000_000
#: Below it two different doubles may lie within the tolerance of conditions, 1e-9.
CLOSE = float(1 << 24)

COUNTS = ("n_consistent", "n_condition", "n_numeric", "n_relation")
KINDS = ("consistent", "condition_difference", "numeric_conflict", "relation_conflict")


def _condition_key(parsed: Column) -> Column:
    """A text that is the same for compatible conditions, unless two of their numbers lie in neighbouring cells of 1e-9."""
    return F.concat_ws(";", F.transform(parsed, lambda c: hashing.packed(c["k"], c["u"], _cell(c["n"]), F.when(c["n"].isNull(), c["t"]))))


def _cell(n: Column) -> Column:
    return F.when(F.abs(n) < CLOSE, n.cast("decimal(20,9)").cast("string")).otherwise(n.cast("string"))


def _points(a: DataFrame, old: bool, config: Config) -> DataFrame:
    """What the sweep sees of an assertion. begin and end: of an existing one's interval, with its tolerance on both sides; a new one
    has its own ends the other way round, as it looks for beginnings up to its end and for ends before its beginning."""
    low, high, textual = F.col("s_low"), F.col("s_high"), F.col("s_type").isin(*TEXT_TYPES)
    numeric = ~textual & (F.col("s_type") != "formula") & low.isNotNull()
    pad = F.greatest(F.lit(config.relative_tolerance) * F.greatest(F.abs(low), F.abs(high)), F.lit(config.absolute_tolerance))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int") if old else F.lit(0)
    return _comparable(a, "s").where("entity is not null and property is not null and s_ref is not null").select(
        "entity", "property", F.col("s_ref").alias("ref"), F.col("s_id").alias("id"), F.col("s_cond").alias("conditions"), _condition_key(F.col("s_cond")).alias("cond"),
        F.coalesce(textual, F.lit(False)).alias("textual"), F.coalesce(numeric, F.lit(False)).alias("numeric"), F.lower(F.trim(F.coalesce("s_text", F.col("s_num").cast("string")))).alias("value"),
        (low - pad if old else high).alias("begin"), (high + pad if old else low).alias("end"), (textual & F.col("s_num").isNotNull()).alias("odd"),
        F.lit(int(old)).alias("old"), flag(textual).alias("old_text"), flag(numeric).alias("old_number"),
    )


def _numeric_conditions(a: DataFrame) -> DataFrame:
    """The assertions that may have a number among their conditions, told by its first sign, before any is parsed."""
    return a.where(F.exists("conditions", lambda c: F.trim(c["value"]).rlike(r"^[+\-.0-9]")))


def _apart(points: DataFrame, numeric: DataFrame) -> DataFrame:
    """numeric: those of the points whose conditions may have numbers. (entity, property, way) of the groups that need another way than a sort within a task: `pairs` where equality is not that
    of keys (numbers of conditions in neighbouring cells within the tolerance, texts that also have a number), `spread` where there
    are more than TASK_ROWS rows."""
    size = points.groupBy("entity", "property").agg(F.count("*").alias("n"), F.bool_or("odd").alias("odd")).where(f"odd or n > {TASK_ROWS}")
    size = size.select("entity", "property", F.when(F.col("odd"), "pairs").otherwise("spread").alias("way"))
    numbers = numeric.where(F.exists("conditions", lambda c: c["n"].isNotNull() & (F.abs(c["n"]) < CLOSE))).select("entity", "property", F.explode("conditions").alias("c")).where("c.n is not null")
    cells = numbers.select("entity", "property", F.col("c.k").alias("k"), F.col("c.u").alias("u"), F.col("c.n").alias("n"), F.col("c.n").cast("decimal(20,9)").alias("cell")).groupBy("entity", "property", "k", "u", "cell").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    after = cells.select("entity", "property", "k", F.col("u").alias("u2"), (F.col("cell") - F.lit("0.000000001").cast("decimal(20,9)")).cast("decimal(20,9)").alias("cell"), F.col("lo").alias("next"))
    near = cells.join(after, ["entity", "property", "k", "cell"]).where(F.col("u").eqNullSafe(F.col("u2")) & (F.col("next") - F.col("hi") <= 1e-9))
    return size.unionByName(near.select("entity", "property", F.lit("pairs").alias("way"))).groupBy("entity", "property").agg(F.min("way").alias("way"))


#: What is counted of existing assertions, in all and of the own document alone: of the same entity and property, then of compatible
#: conditions too, of an equal value, and of intervals that begin, or end, up to a place.
_STEPS = (
    Step((), {"all": "old"}), Step(("ref",), {"own": "old"}),
    Step(("cond",), {"all_same": "old", "all_text": "old_text", "all_number": "old_number"}), Step(("cond", "ref"), {"own_same": "old", "own_text": "old_text", "own_number": "old_number"}),
    Step(("cond", "value"), {"equal": "old", "equal_text": "old_text"}), Step(("cond", "value", "ref"), {"own_equal": "old", "own_equal_text": "old_text"}),
    Step(("cond",), {"begun": "old_number"}, "begin", "old"), Step(("cond", "ref"), {"own_begun": "old_number"}, "begin", "old"),
    Step(("cond",), {"ended": "old_number"}, "end", "old", False), Step(("cond", "ref"), {"own_ended": "old_number"}, "end", "old", False),
)


def _counted(points: DataFrame, way) -> DataFrame:
    """For each new assertion, how many existing ones of other documents it agrees and disagrees with, and how.

    A count over other documents is that over all less that over the own one. Of existing intervals, those that meet a new one are
    those that begin up to its end less those that end before its beginning.
    """
    p, c = way(points.drop("conditions", "odd"), ["entity", "property"], _STEPS, ["id", "ref", "textual", "numeric"], "old"), F.col
    same = c("all_same") - c("own_same")
    equal = F.when(c("textual"), c("equal") - c("own_equal")).otherwise(c("equal_text") - c("own_equal_text"))
    texts = F.when(c("textual"), same).otherwise(c("all_text") - c("own_text"))
    meet = F.when(c("numeric"), (c("begun") - c("ended")) - (c("own_begun") - c("own_ended"))).otherwise(0)
    numbers = F.when(c("numeric"), c("all_number") - c("own_number")).otherwise(0)
    counts = (equal + meet, c("all") - c("own") - same, numbers - meet, texts - equal)
    return p.select("id", c("ref").alias("ref_id"), *(x.alias(n) for x, n in zip(counts, COUNTS, strict=True)))


def conflict_counts(new: DataFrame, existing: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """id, ref_id, n_consistent, n_condition, n_numeric, n_relation of each new assertion: how many pairs of each kind conflicts()
    gives for it, without making any. Assertions without a pair have zeros; those without an entity, property or document are
    left out, as nothing is compared with them. Null conditions count as none.

    Counts come from sorted groups (see sweep): n log n for a group of n assertions, and never more rows than assertions. Groups
    beyond TASK_ROWS rows are spread over tasks. Groups where equality is not that of keys are rare, and compared in pairs.
    """
    both = lambda some: _points(some(new), False, config).unionByName(_points(some(existing), True, config))
    points = both(lambda a: a)
    other = written(_apart(points, both(_numeric_conditions)), "apart")
    key = ["entity", "property"]
    if other.isEmpty():
        return _counted(points, in_tasks)
    out = _counted(points.join(other, key, "left_anti"), in_tasks)
    for way in [r.way for r in other.select("way").distinct().collect()]:
        mine = other.where(F.col("way") == way).select(*key)
        if way == "spread":
            out = out.unionByName(_counted(written(points.join(mine, key, "left_semi"), "spread"), spread))
        else:
            some = new.join(mine, key, "left_semi")
            found = conflicts(some, existing.join(mine, key, "left_semi"), config).groupBy(F.col("new_id").alias("id"), F.col("new_ref").alias("ref_id"))
            found = found.agg(*(F.count_if(F.col("conflict_type") == kind).alias(n) for n, kind in zip(COUNTS, KINDS, strict=True)))
            out = out.unionByName(some.where("ref_id is not null").select("id", "ref_id").join(found, ["id", "ref_id"], "left").fillna(0, list(COUNTS)))
    return out


def mechanism_violations(assertions: DataFrame, rules: DataFrame) -> DataFrame:
    """id, ref_id, rule_id of assertions beyond the bounds (lo, hi; null for none) of a rule for their property."""
    return assertions.join(rules, "property").where("value_num < lo or value_num > hi").select("id", "ref_id", "rule_id")


def rejected_sets(assertions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """id, ref_id, rule_id from the verdicts (ref_id, ok, violated, rule_id) of a validator of whole documents: the violated
    ids, or all of a document's assertions where a verdict names none."""
    bad = verdicts.where("not ok")
    named = bad.where("size(violated) > 0").select(F.explode("violated").alias("id"), "ref_id", "rule_id")
    return named.unionByName(assertions.join(bad.where("coalesce(size(violated), 0) <= 0").select("ref_id", "rule_id"), "ref_id").select("id", "ref_id", "rule_id"))


def conflict_flags(counts: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """One row for each new assertion that has any: which kinds of conflict it has, from conflict_counts() and violations."""
    kinds = dict(zip(("consistent", "condition_diff", "numeric", "relation"), COUNTS, strict=True))
    rows = counts.select("id", "ref_id", *((F.col(n) > 0).alias(k) for k, n in kinds.items()), F.lit(False).alias("mechanism"))
    if violations is not None:
        rows = rows.unionByName(violations.select("id", "ref_id", *(F.lit(False).alias(k) for k in kinds), F.lit(True).alias("mechanism")))
    any_ = F.col("mechanism")
    for k in kinds:
        any_ |= F.col(k)
    return rows.where(any_).groupBy("id", "ref_id").agg(*(F.bool_or(k).alias(k) for k in FLAGS))


FLAGS = ("consistent", "condition_diff", "numeric", "relation", "mechanism")


def quality(documents: DataFrame, assertions: DataFrame, flags: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """ref_id, p_parse, s_schema, e_evidence, n_novelty, penalty, total in [0, 1] (9 digits)."""
    a = assertions.groupBy("ref_id").agg(F.count("*").alias("n"), F.count_if(~locator_missing()).alias("located"), F.count_if(F.col("source_claim_origin") == "primary").alias("firsthand"))
    c = flags.groupBy("ref_id").agg(F.count_if("consistent").alias("same"), F.bool_or(F.col("numeric") | F.col("relation")).alias("hang"), F.bool_or("mechanism").alias("mech"))
    charts_low = F.exists(F.coalesce("charts", F.array()), lambda x: x["not_digitizable"] | x["quality_low"] | ~(x["caption_complete"] & x["axes_complete"] & x["units_complete"]))
    d = documents.join(a, "ref_id", "left").join(c, "ref_id", "left").fillna(0, ["n", "located", "firsthand", "same"]).fillna(False, ["hang", "mech"])
    p = F.lit(0.0)
    for grade, score in config.grade_scores:
        p = F.when(F.col("quality_grade") == grade, F.lit(score)).otherwise(p)
    s = F.when((F.col("schema_total_count") > 0) & F.col("schema_valid_count").isNotNull(), intervals.unit_interval(F.col("schema_valid_count") / F.col("schema_total_count"))).otherwise(1.0)
    none = F.col("n") == 0
    e = F.when(none, 0.0).otherwise((F.col("located") / F.col("n") + F.col("firsthand") / F.col("n")) / 2)
    n = F.when(none, 1.0).otherwise(intervals.unit_interval(1 - F.col("same") / F.col("n")))
    cut = lambda flag, by: F.when(flag, F.lit(by)).otherwise(0.0)
    penalty = F.greatest(F.lit(0.0), 1 - cut(F.col("hang"), config.conflict_penalty) - cut(F.col("mech"), config.mechanism_penalty) - cut(charts_low, config.chart_penalty))
    d = d.select("ref_id", p.alias("p_parse"), s.alias("s_schema"), e.alias("e_evidence"), n.alias("n_novelty"), penalty.alias("penalty"))
    w = config.weights
    total = w.parse * F.col("p_parse") + w.schema * F.col("s_schema") + w.evidence * F.col("e_evidence") + w.novelty * F.col("n_novelty") + w.penalty * F.col("penalty")
    r = lambda x: F.round(x, 9)
    return d.select("ref_id", *(r(F.col(c)).alias(c) for c in ("p_parse", "s_schema", "e_evidence", "n_novelty", "penalty")), r(intervals.unit_interval(total)).alias("total"))


def decide(assertions: DataFrame, complete: DataFrame, flags: DataFrame) -> DataFrame:
    """assertion_id, ref_id, action, confidence, conflict_type, reason: the first rule that applies decides.

    Consistency with another source raises a first-hand assertion to high; nothing ever grants verified.
    """
    a = assertions.join(complete.select("ref_id", "status", "requires_manual_review"), "ref_id").join(flags.select("id", *FLAGS), "id", "left").fillna(False, list(FLAGS))
    own, primary = F.col("confidence"), F.col("source_claim_origin") == "primary"
    no_unit = F.coalesce("missing_unit", F.lit(False)) | (F.col("value_type").isin(*NUMERIC_TYPES) & blank(F.col("unit")))
    low, ceiling = F.lit("hypothesis"), intervals.at_most_medium(own)
    rules = [
        (F.col("status") == "metadata_incomplete", "return_upstream", low, None, "metadata_incomplete"),
        (F.col("status") == "parsed_doc_not_formal", "reject", low, None, "not_formal"),
        (F.col("status") == "explicit_no_data", "reject", low, None, "no_data"),
        (F.col("mechanism"), "reject", low, "mechanism_violation", "mechanism_violation"),
        (F.col("numeric"), "pending_review", low, "numeric_conflict", "conflict"),
        (F.col("relation"), "pending_review", low, "relation_conflict", "conflict"),
        (no_unit, "downgrade", low, None, "missing_unit"),
        (locator_missing(), "downgrade", low, None, "missing_locator"),
        (F.coalesce("speculative_wording", F.lit(False)), "downgrade", low, None, "speculative"),
        (F.col("requires_manual_review") & (F.col("status") == "manual_review"), "pending_review", F.lit("medium"), None, "grade_c"),
        (F.col("consistent") & ~primary, "accept", ceiling, "consistent", "consistent_secondary"),
        (F.col("consistent") & (own == "hypothesis"), "accept", low, "consistent", "consistent_hypothesis"),
        (F.col("consistent"), "accept", F.lit("high"), "consistent", "consistent_primary"),
        (F.col("condition_diff"), "accept", ceiling, "condition_difference", "condition_difference"),
        (F.lit(True), "accept", ceiling, None, "single_source"),
    ]
    outcome = F.coalesce(*(F.when(when, F.struct(F.lit(act).alias("action"), conf.alias("confidence"), F.lit(kind).cast("string").alias("conflict_type"), F.lit(why).alias("reason"))) for when, act, conf, kind, why in rules))
    return a.select(F.col("id").alias("assertion_id"), "ref_id", outcome.alias("o")).select("assertion_id", "ref_id", "o.*")


ACTIONS = ("accept", "downgrade", "pending_review", "reject", "return_upstream")


def report(documents: DataFrame, decisions: DataFrame, scores: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row for each document: counts of actions, report status, quality and whether it is low. Quality only warns."""
    counts = decisions.groupBy("ref_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ACTIONS))
    d = documents.select("ref_id").join(counts, "ref_id", "left").fillna(0).join(scores.select("ref_id", "total"), "ref_id", "left")
    n = F.col("n")
    status = (
        F.when(F.col("n_return_upstream") > 0, "return_upstream").when(n == 0, "no_assertions").when(F.col("n_accept") == n, "successful").when(F.col("n_reject") == n, "rejected")
        .when(F.col("n_pending_review") > 0, "pending_review").when(F.col("n_downgrade") > 0, "downgraded").otherwise("partial")
    )
    return d.select("ref_id", *(F.col(f"n_{a}") for a in ACTIONS), status.alias("report_status"), F.col("total").alias("quality"), (F.col("total") < config.low_quality).alias("low_quality"))


@dataclass
class Curation:
    completeness: DataFrame
    counts: DataFrame
    quality: DataFrame
    decisions: DataFrame
    reports: DataFrame


def curate(documents: DataFrame, new: DataFrame, existing: DataFrame, rules: DataFrame | None = None, config: Config = DEFAULT) -> Curation:
    found = conflict_counts(new, existing, config)
    # Written, as both scores and decisions, and whatever is made of them, read the flags: the conflicts are counted once.
    flags = written(conflict_flags(found, mechanism_violations(new, rules) if rules is not None else None), "flags")
    complete, scores = completeness(documents, new), quality(documents, new, flags, config)
    decisions = decide(new, complete, flags)
    return Curation(complete, found, scores, decisions, report(documents, decisions, scores, config))


#: Where an admitted assertion may be seen, by action; rejected and returned ones are not admitted.
VISIBILITY = {"accept": "active", "downgrade": "downgraded", "pending_review": "pending", "supersede": "superseded"}


def admit(decisions: DataFrame, assertions: DataFrame) -> DataFrame:
    """Assertions whose decision admits them, with visibility and a content hash."""
    visible = F.lit(None).cast("string")
    for action, v in VISIBILITY.items():
        visible = F.when(F.col("action") == action, F.lit(v)).otherwise(visible)
    d = decisions.select(F.col("assertion_id").alias("id"), "action", F.col("confidence").alias("decided_confidence"), visible.alias("visibility")).where("visibility is not null")
    return assertions.join(d, "id").withColumn("assertion_hash", assertion_hash(assertions))


#: What a hash of an assertion covers, by purpose. Columns that a frame lacks count as null.
SUBJECT = ("eddo_class", "entity", "property")
VALUE = ("value_type", "value_num", "value_lo", "value_hi", "value_text", "unit", "uncertainty")
MARKS = ("missing_unit", "speculative_wording", "chart_quality_low")
COMMITTED = ("id", "ref_id", *SUBJECT, "mention", *VALUE, "locator", "sentence", "claim_type", "source_claim_origin", "quality")


def _hash(assertions: DataFrame, columns: tuple[str, ...], length: int = 64) -> Column:
    """Doubles count with all of their digits."""
    have = set(assertions.columns)
    parts = [F.col(c) if c in have else F.lit(None).cast("string") for c in columns]
    return hashing.canonical_hash(*parts, hashing.conditions_text(F.col("conditions")), length=length)


def slot_key(assertions: DataFrame) -> Column:
    """What an assertion is about: class and entity, property, conditions, claim and value type; not its value or origin."""
    return _hash(assertions, (*SUBJECT, "claim_type", "value_type"), 16)


def assertion_hash(assertions: DataFrame) -> Column:
    """What a commit records of an assertion."""
    return _hash(assertions, COMMITTED)


def material_hash(assertions: DataFrame) -> Column:
    """What a publication compares: all that was committed, confidence and marks."""
    return _hash(assertions, (*COMMITTED, "confidence", *MARKS))


def semantic_hash(assertions: DataFrame) -> Column:
    """What an assertion says, wherever it stands: not its id, reference, locator, confidence or quality."""
    return _hash(assertions, (*SUBJECT, "mention", *VALUE, "claim_type", "source_claim_origin", *MARKS), 16)


def decision_hash() -> Column:
    """What was decided: id, action, decided_confidence, visibility."""
    return hashing.canonical_hash(*(F.col(c) for c in ("id", "action", "decided_confidence", "visibility")))


def metadata_hash(metadata: Column) -> Column:
    authors = hashing.packed(F.size(metadata["authors"]), F.array_join(F.transform(metadata["authors"], lambda a: hashing.packed(a)), ""))
    return hashing.canonical_hash(metadata["title"], authors, *(metadata[c] for c in ("year", "source", "doi", "stable_id")))


def slot_duplicates(assertions: DataFrame) -> DataFrame:
    """ref_id, slot_key, n of slots that a document fills more than once."""
    return assertions.select("ref_id", slot_key(assertions).alias("slot_key")).groupBy("ref_id", "slot_key").agg(F.count("*").alias("n")).where("n > 1")


def commit_eligibility(reports: DataFrame) -> DataFrame:
    """Whether a document's report may be published, and the first reason against it."""
    n = sum((F.col(f"n_{a}") for a in ACTIONS), F.lit(0))
    reason = F.when(F.col("report_status") == "return_upstream", "returned_upstream").when(n == 0, "no_decisions").when(F.col("n_reject") == n, "all_rejected")
    return reports.select("ref_id", reason.isNull().alias("publishable"), reason.alias("reason"))


def request_errors(decisions: DataFrame, assertions: DataFrame) -> DataFrame:
    """id, error of a commit request: repeated assertions or decisions, decisions without assertion, assertions without decision."""
    twice = lambda df, c, e: df.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(e).alias("error"))
    a, d = assertions.select("id"), decisions.select(F.col("assertion_id").alias("id"))
    out = twice(assertions, "id", "duplicate_assertion").unionByName(twice(decisions, "assertion_id", "duplicate_decision"))
    out = out.unionByName(a.join(d, "id", "left_anti").distinct().select("id", F.lit("missing_decision").alias("error")))
    return out.unionByName(d.join(a, "id", "left_anti").distinct().select("id", F.lit("extra_decision").alias("error")))


def snapshot_manifest(admitted: DataFrame) -> DataFrame:
    """ref_id, n_assertions, content_hash: the hash of what was admitted, in whatever order."""
    return admitted.groupBy("ref_id").agg(F.count("*").alias("n_assertions"), hashing.set_hash(F.col("assertion_hash")).alias("content_hash"))
