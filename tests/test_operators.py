"""Single operators on hand-made rows, and the traps of their rules."""

from __future__ import annotations

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from evidence_spark.api import Engine
from evidence_spark.functions import intervals, vectors
from evidence_spark.functions import text as T
from evidence_spark.operators import bm25, chunking, curation, delta, evidence, fusion, guard, hybrid, identity, lifecycle, publication, tasks, vector, versions
from evidence_spark.sources import codec
from evidence_spark.sources.store import ConflictError, Store
from evidence_spark.streaming import outbox

COND = "array<struct<eddo_class: string, value: string, unit: string>>"
ASSERTION = f"id string, ref_id string, entity string, property string, value_type string, value_num double, value_lo double, value_hi double, value_text string, uncertainty double, unit string, conditions {COND}, locator string, claim_type string, source_claim_origin string, confidence string, missing_unit boolean, speculative_wording boolean"
DOCUMENT = "ref_id string, metadata struct<title: string, authors: array<string>, year: int, source: string, doi: string, stable_id: string>, quality_grade string, no_structured_data boolean, schema_valid_count int, schema_total_count int, charts array<struct<id: string, caption_complete: boolean, axes_complete: boolean, units_complete: boolean, not_digitizable: boolean, quality_low: boolean>>"
DEFAULT_CONDITIONS = [("Temperature", "298.15", "K"), ("FeedNaCl", "0.05", "mol/L")]


def assertion(id="A1", ref="R1", **kw):
    row = {"id": id, "ref_id": ref, "entity": "E", "property": "P", "value_type": "number", "value_num": 1.42, "value_lo": None, "value_hi": None, "value_text": None, "uncertainty": 0.05, "unit": "kWh/m3", "conditions": DEFAULT_CONDITIONS, "locator": "T12", "claim_type": "measurement", "source_claim_origin": "primary", "confidence": "medium", "missing_unit": False, "speculative_wording": False}
    return tuple({**row, **kw}.values())


def document(ref="R1", grade="B", doi="10.1/x", none=False, valid=None, total=None, charts=()):
    return (ref, ("T", ["A"], 2024, "J", doi, "ST"), grade, none, valid, total, list(charts))


def assertions(spark, *rows):
    return spark.createDataFrame(list(rows), ASSERTION)


def documents(spark, *rows):
    return spark.createDataFrame(list(rows), DOCUMENT)


def conflict(spark, new, existing):
    rows = curation.conflicts(assertions(spark, assertion("N", "R1", **new)), assertions(spark, assertion("E", "R2", **existing))).collect()
    return rows[0].conflict_type if rows else None


# --- conflicts ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("new", "existing", "kind"),
    [
        ({"value_num": 1.40, "uncertainty": 0.1}, {"value_num": 1.45, "uncertainty": 0.1}, "consistent"),
        ({"value_num": 104.0, "uncertainty": None}, {"value_num": 100.0, "uncertainty": None}, "consistent"),
        ({"value_num": 109.0, "uncertainty": None}, {"value_num": 100.0, "uncertainty": None}, "numeric_conflict"),
        ({"value_num": 0.0104, "uncertainty": None}, {"value_num": 0.0100, "uncertainty": None}, "consistent"),
        ({"value_num": 0.0109, "uncertainty": None}, {"value_num": 0.0100, "uncertainty": None}, "numeric_conflict"),
        # Only the existing side is padded: 95.1 is within 5 % of 100 above it, not the other way round.
        ({"value_num": 95.1, "uncertainty": None}, {"value_num": 100.0, "uncertainty": None}, "consistent"),
        ({"value_num": 100.0, "uncertainty": None}, {"value_num": 95.1, "uncertainty": None}, "numeric_conflict"),
        ({"value_type": "range", "value_num": None, "value_lo": 3.0, "value_hi": 1.0}, {"value_num": 2.0}, "consistent"),
        ({"value_type": "enum", "value_num": None, "value_text": " High"}, {"value_type": "enum", "value_num": None, "value_text": "high"}, "consistent"),
        ({"value_type": "enum", "value_num": None, "value_text": "low"}, {"value_type": "enum", "value_num": None, "value_text": "high"}, "relation_conflict"),
        ({"value_type": "enum", "value_num": None, "value_text": "low", "conditions": []}, {"value_type": "enum", "value_num": None, "value_text": "high"}, "condition_difference"),
        ({"value_type": "formula", "value_num": None, "value_text": "x"}, {"value_num": 2.0}, None),
        ({"conditions": [("feednacl", "0.050", "mol/L"), ("temperature", "298.15", "K")]}, {}, "consistent"),
        ({"conditions": [("Temperature", "298.15", None), ("FeedNaCl", "0.05", "mol/L")]}, {}, "condition_difference"),
    ],
)
def test_conflict_kinds(spark, new, existing, kind):
    assert conflict(spark, new, existing) == kind


def test_no_conflict_within_a_document(spark):
    a = assertions(spark, assertion("N", "R1"))
    assert curation.conflicts(a, assertions(spark, assertion("E", "R1", value_num=9.0))).isEmpty()


def _mixed_assertions(seed: int, n: int):
    """Two entities, one of them with most rows; every type, ties, nulls, numbers of conditions within and near the tolerance."""
    rng = random.Random(seed)
    numbers = ["298.15", "298.150", "298.15000000049", "298.1500000010001", "x", "X ", None, "1e9", "1000000000", "0.3", "0.30000000000000004"]
    out = []
    for i in range(n):
        kind = rng.choice(["number"] * 6 + ["range", "enum", "text", "formula"])
        num = rng.choice([1.0, 1.04, 1.05, 1.06, 2.0, None, -1.0, 0.0]) if kind == "number" else rng.choice([None, None, None, 1.0]) if kind == "text" and seed % 2 else None
        lo, hi = (rng.choice([0.5, 1.0, 3.0]), rng.choice([0.9, 2.0, None])) if kind == "range" else (None, None)
        text = rng.choice(["high", " High", "low", None, "1.0"]) if kind in ("enum", "text", "formula") else None
        conditions = rng.choice([[], [("T", rng.choice(numbers[:4] if seed % 3 == 0 else ["298.15", "298.150", "299"]), "K")], [("t", "298.15", "K"), ("P", rng.choice(numbers[4:]), rng.choice([None, "bar"]))], None])
        out.append(assertion(f"{'NE'[i % 2]}{i}", rng.choice(["R1", "R2", "R3", "R4", None]), entity=rng.choice(["hot"] * 5 + ["E", None]), property=rng.choice(["P", "P", "Q", None]), value_type=kind, value_num=num, value_lo=lo, value_hi=hi, value_text=text, uncertainty=rng.choice([None, 0.0, 0.01, -0.5]), conditions=conditions))
    return out[::2], out[1::2]


@pytest.mark.parametrize(("seed", "limit"), [(1, 10**6), (2, 10**6), (3, 10**6), (4, 10), (8, 10), (9, 10)])
def test_conflict_counts_equal_pairs(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(curation, "TASK_ROWS", limit)
    new, existing = (assertions(spark, *rows) for rows in _mixed_assertions(seed, 500))
    pairs = {}
    for r in curation.conflicts(new, existing).collect():
        pairs.setdefault(r.new_id, [0] * 4)[curation.KINDS.index(r.conflict_type)] += 1
    got = {r.id: [r[c] for c in curation.COUNTS] for r in curation.conflict_counts(new, existing).collect()}
    assert {k: v for k, v in got.items() if any(v)} == pairs and {k for k, v in got.items() if not any(v)} == {r.id for r in new.where("entity is not null and property is not null and ref_id is not null").collect()} - set(pairs)
    flags = {r.id: (r.consistent, r.condition_diff, r.numeric, r.relation) for r in curation.conflict_flags(curation.conflict_counts(new, existing)).collect()}
    assert flags == {k: tuple(n > 0 for n in v) for k, v in pairs.items()}


def test_conflict_counts_of_one_large_entity(spark):
    """A million assertions of one entity and property, half of them new: no pair could be listed."""
    n = 1_000_000
    value = F.when(F.col("id") % 2 == 0, F.col("id") * 1000.0).otherwise(F.col("id") * 1000.0 - 1000.0)
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("R"), F.col("id") % 2).alias("ref_id"), F.lit("E").alias("entity"), F.lit("P").alias("property"), F.lit("number").alias("value_type"), value.alias("value_num"), F.lit(None).cast("double").alias("value_lo"),
        F.lit(None).cast("double").alias("value_hi"), F.lit(None).cast("string").alias("value_text"), F.lit(0.0).alias("uncertainty"), F.lit(None).cast(COND).alias("conditions"),
    )
    got = curation.conflict_counts(rows.where("ref_id = 'R0'"), rows.where("ref_id = 'R1'"), curation.DEFAULT.__class__(relative_tolerance=0.0)).agg(F.sum("n_consistent").alias("same"), F.sum("n_numeric").alias("apart"), F.count("*").alias("rows")).first()
    assert (got.rows, got.same, got.apart) == (n // 2, n // 2, (n // 2) * (n // 2 - 1))


# --- completeness, quality, decisions ----------------------------------------------------------------------------------


def test_completeness_ladder(spark):
    docs = documents(spark, document("ok"), document("nodoi", doi=None), document("d", "D"), document("none", none=True), document("empty"), document("unit", "C"), document("c", "C"), document("loc"), document("chart", charts=[("c", True, False, True, False, False)]))
    docs = docs.withColumn("metadata", F.when(F.col("ref_id") == "nodoi", F.col("metadata").withField("stable_id", F.lit(""))).otherwise(F.col("metadata")))
    a = assertions(spark, *(assertion(r, r) for r in ("ok", "nodoi", "d", "c", "chart")), assertion("u", "unit", unit=" "), assertion("l", "loc", locator=""))
    got = {r.ref_id: r for r in curation.completeness(docs, a).collect()}
    assert {k: r.status for k, r in got.items()} == {"ok": "ok", "nodoi": "metadata_incomplete", "d": "parsed_doc_not_formal", "none": "explicit_no_data", "empty": "no_assertions", "unit": "missing_units", "c": "manual_review", "loc": "missing_locators", "chart": "chart_quality_low"}
    assert got["unit"].issues == ["missing_units", "parsed_doc_manual_review"] and got["none"].allows_formal and not got["empty"].allows_formal


def test_quality_parts(spark):
    docs = documents(spark, document("a", "A", valid=1, total=2), document("n", "B"), document("z", "E", valid=9, total=3))
    a = assertions(spark, assertion("1", "a"), assertion("2", "a", locator="", source_claim_origin="secondary"), assertion("3", "z"))
    flags = spark.createDataFrame([("1", "a", True, False, True, False, True)], "id string, ref_id string, consistent boolean, condition_diff boolean, numeric boolean, relation boolean, mechanism boolean")
    q = {r.ref_id: r for r in curation.quality(docs, a, flags).collect()}
    assert (q["a"].p_parse, q["a"].s_schema, q["a"].e_evidence, q["a"].n_novelty, q["a"].penalty) == (1.0, 0.5, 0.5, 0.5, 0.4)
    assert q["a"].total == pytest.approx(0.25 + 0.125 + 0.15 + 0.05 + 0.04)
    assert (q["n"].e_evidence, q["n"].n_novelty, q["z"].p_parse, q["z"].s_schema) == (0.0, 1.0, 0.0, 1.0)


def test_decisions(spark):
    docs = documents(spark, *(document(r, g) for r, g in (("ok", "A"), ("c", "C"), ("cu", "C"), ("d", "D"))))
    base = dict(confidence="verified")
    rows = [
        assertion("plain", "ok", **base), assertion("same", "ok", entity="S", **base), assertion("same2", "ok", entity="S", source_claim_origin="secondary", **base), assertion("hypo", "ok", entity="S", confidence="hypothesis"), assertion("diff", "ok", entity="D", confidence="high"),
        assertion("num", "ok", entity="N"), assertion("spec", "ok", speculative_wording=True), assertion("c1", "c"), assertion("cu1", "cu"), assertion("cu2", "cu", unit=None), assertion("d1", "d"), assertion("mech", "ok", entity="N", property="M", value_num=9.0),
    ]
    a, none = assertions(spark, *rows), dict(uncertainty=0.0)
    existing = assertions(spark, assertion("x1", "R9", entity="S"), assertion("x2", "R9", entity="D", conditions=[]), assertion("x3", "R9", entity="N", value_num=50.0, **none))
    rules = spark.createDataFrame([("M", 0.0, 1.0, "m")], "property string, lo double, hi double, rule_id string")
    c = curation.curate(docs, a, existing, rules)
    got = {r.assertion_id: (r.action, r.confidence, r.conflict_type) for r in c.decisions.collect()}
    assert got == {
        "plain": ("accept", "medium", None), "same": ("accept", "high", "consistent"), "same2": ("accept", "medium", "consistent"), "hypo": ("accept", "hypothesis", "consistent"), "diff": ("accept", "medium", "condition_difference"),
        "num": ("pending_review", "hypothesis", "numeric_conflict"), "spec": ("downgrade", "hypothesis", None), "c1": ("pending_review", "medium", None), "cu1": ("accept", "medium", None), "cu2": ("downgrade", "hypothesis", None), "d1": ("reject", "hypothesis", None), "mech": ("reject", "hypothesis", "mechanism_violation"),
    }
    reports = {r.ref_id: r.report_status for r in c.reports.collect()}
    assert reports == {"ok": "pending_review", "c": "pending_review", "cu": "downgraded", "d": "rejected"}
    gate = {r.ref_id: r.reason for r in curation.commit_eligibility(c.reports).collect()}
    assert gate == {"ok": None, "c": None, "cu": None, "d": "all_rejected"}
    assert {r.id for r in curation.admit(c.decisions, a).collect()} == set(got) - {"d1", "mech"}
    errors = {(r.id, r.error) for r in curation.request_errors(c.decisions.where("assertion_id != 'num'"), a.where("id != 'spec'")).collect()}
    assert errors == {("num", "missing_decision"), ("spec", "extra_decision")}


# --- retrieval ---------------------------------------------------------------------------------------------------------


def naive_windows(n, body, step):
    out, start = [], 0
    while True:
        out.append((start, min(n, start + body)))
        if start + body >= n:
            return out
        start += step


def test_windows_equal_a_loop(spark):
    rng = random.Random(1)
    docs = [(f"R{i}", "".join(rng.choice(["ab", " ", "\n", "c"]) for _ in range(n)), None if i % 2 else "p", "") for i, n in enumerate([0, 1, 5, 600, 900, 1000, 3000])]
    got = {}
    for r in chunking.chunk_text(spark.createDataFrame(docs, "ref_id string, text string, page string, section string")).collect():
        got.setdefault(r.ref_id, []).append((r.idx, r.payload))
    for ref, text, page, _ in docs:
        tokens = __import__("re").findall(r"\s+|\S+", text)
        prefix = f"[{ref}|{page or '-'}|-|type(文本)]"
        want = [] if not tokens else [prefix + " " + "".join(tokens[a:b]) for a, b in naive_windows(len(tokens), 512 - 1 - 1, 512 - 2 - 64)]
        assert [p for _, p in sorted(got.get(ref, []))] == want


def test_a_prefix_may_not_fill_the_window(spark):
    docs = spark.createDataFrame([("R", "text", "p " * 600, "s")], "ref_id string, text string, page string, section string")
    with pytest.raises(Exception, match="no room"):
        chunking.chunk_text(docs).collect()


CHUNK = "chunk_id string, ref_id string, level string, payload string"


def test_bm25(spark):
    chunks = spark.createDataFrame([("A", "RA", "fine", "the quick brown fox jumps"), ("B", "RB", "fine", "lazy dog sleeps all day"), ("C", "RC", "coarse", "Quick quick")], CHUNK)
    q = spark.createDataFrame([(1, "quick fox"), (2, "nothing here"), (3, "quick quick")], "query_id long, text string")
    got = bm25.bm25_topk(q, chunks, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.rank) for r in got] == [(1, "A", 1), (1, "C", 2), (3, "C", 1), (3, "A", 2)]
    n, avgdl = 3, 4.0
    part = lambda df, tf, dl: math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert got[0].score == pytest.approx(part(2, 1, 5) + part(1, 1, 5), abs=1e-8) and got[2].score == pytest.approx(2 * part(2, 2, 2), abs=1e-8)
    assert [r.chunk_id for r in bm25.bm25_topk(q, chunks, 5, "coarse").collect()] == ["C", "C"]
    none = spark.createDataFrame([], "query_id long, ref_id string")
    assert bm25.bm25_topk(q, chunks, 5, allowed=none).isEmpty()


def test_rrf_takes_the_best_rank_of_a_channel(spark):
    c = spark.createDataFrame([(1, "k", "X", "R", 5), (1, "k", "X", "R", 1), (1, "v", "X", "R", 2), (1, "v", "Y", "R", 1), (1, "k", "Z", "R", 0)], "query_id long, channel string, chunk_id string, ref_id string, rank long")
    got = [(r.chunk_id, r.score, r.n_channels, r.rank) for r in fusion.rrf(c).orderBy("rank").collect()]
    assert got == [("X", round(1 / 61 + 1 / 62, 9), 2, 1), ("Y", round(1 / 61, 9), 1, 2)]


def test_retrieval_with_synonyms_and_a_reranker(spark):
    chunks = spark.createDataFrame([("c1", "R1", "coarse", "salt"), ("f1", "R1", "fine", "salt salt"), ("f2", "R1", "fine", "salt water brine"), ("f2", "R1", "fine", "salt water brine"), ("c2", "R2", "coarse", "other")], CHUNK)
    q = spark.createDataFrame([(1, "brine"), (2, None)], "query_id long, text string")
    syn = spark.createDataFrame([("brine", "salt"), ("brine", "water")], "term string, expansion string")
    assert hybrid.hybrid_retrieve(q, chunks, fallback=False).hits.isEmpty()
    found = hybrid.hybrid_retrieve(q, chunks, fallback=False, synonyms=syn, reranker=fusion.lexical_overlap)
    assert [(r.query_id, r.chunk_id, r.rerank_score, r.rank) for r in found.hits.orderBy("rank").collect()] == [(1, "f2", 1.0, 1), (1, "f1", pytest.approx(1 / 3), 2)]
    assert {r.query_id: r.channels_used for r in found.diagnostics.collect()} == {1: "keyword", 2: ""}
    graph = spark.createDataFrame([(1, "g1", "R1", 1)], "query_id long, chunk_id string, ref_id string, rank long")
    # The hit of the graph has no payload: it is scored on an empty one.
    shorter = hybrid.hybrid_retrieve(q, chunks, graph=graph, synonyms=syn, reranker=lambda _, p: -F.length(p).cast("double"))
    assert [r.chunk_id for r in shorter.hits.orderBy("rank").collect()] == ["g1", "f1", "f2"] and shorter.diagnostics.first().channels_used == "graph,keyword"
    with pytest.raises(Exception, match="no finite score"):
        hybrid.hybrid_retrieve(q, chunks, synonyms=syn, reranker=lambda *_: F.lit(float("nan"))).hits.collect()
    with pytest.raises(ValueError, match="payloads are needed"):
        hybrid.hybrid_retrieve(q, bm25.Index.for_queries(q, chunks), reranker=fusion.lexical_overlap)


def test_coarse_hits_restrict_fine_ones(spark):
    chunks = spark.createDataFrame([("c1", "R1", "coarse", "alpha"), ("f1", "R1", "fine", "beta alpha"), ("f2", "R2", "fine", "alpha alpha"), ("f3", "R3", "fine", "gamma")], CHUNK)
    q = spark.createDataFrame([(1, "alpha"), (2, "gamma")], "query_id long, text string")
    with_fallback = hybrid.hybrid_retrieve(q, chunks)
    assert [(r.query_id, r.chunk_id) for r in with_fallback.hits.orderBy("query_id").collect()] == [(1, "f1"), (2, "f3")]
    assert {r.query_id: r.coarse_status for r in with_fallback.diagnostics.collect()} == {1: "ok", 2: "fallback"}
    strict = hybrid.hybrid_retrieve(q, chunks, fallback=False)
    assert [r.chunk_id for r in strict.hits.collect()] == ["f1"] and strict.diagnostics.where("coarse_status = 'empty'").count() == 1
    graph = spark.createDataFrame([(1, "g1", "R1", 1), (1, "g2", "R9", 2)], "query_id long, chunk_id string, ref_id string, rank long")
    assert {r.chunk_id for r in hybrid.hybrid_retrieve(q, chunks, graph=graph).hits.where("query_id = 1").collect()} == {"f1", "g1"}
    hidden = hybrid.hybrid_retrieve(q, chunks, visible=spark.createDataFrame([("R2",), ("R3",)], "ref_id string"))
    assert {r.chunk_id for r in hidden.hits.collect()} == {"f2", "f3"}


def widen(ranks, target, size):
    depth = 50
    while True:
        found = [r for r in ranks if r <= depth]
        if len(found) >= target or depth >= size:
            return found
        depth *= 2


def test_eligible_depth_equals_widening(spark):
    rng, rows, want = random.Random(3), [], {}
    for q in range(30):
        size, share, target = rng.randrange(1, 600), rng.random() ** 2, 5
        good = [r for r in range(1, size + 1) if rng.random() < share]
        rows += [(q, f"c{r}", "yes" if r in set(good) else "no", r) for r in range(1, size + 1)]
        want[q] = widen(good, target, size)
    got = {q: [] for q in want}
    ranked = spark.createDataFrame(rows, "query_id long, chunk_id string, ref_id string, rank long")
    for r in hybrid.eligible_hits(ranked, spark.createDataFrame([("yes",)], "ref_id string"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.rank)
    assert got == want


def test_progressive_search_equals_widening(spark):
    rng, rows, want = random.Random(4), [], {}
    for q in range(12):
        size = rng.randrange(1, 500)
        good = {r for r in range(1, size + 1) if rng.random() < 0.05 * (q + 1) / 6}
        rows += [(f"q{q}", f"c{r}", "yes" if r in good else "no", r) for r in range(1, size + 1)]
        want[f"q{q}"] = widen(sorted(good), 5, size)
    ranked = spark.createDataFrame(rows, "query_id string, chunk_id string, ref_id string, rank long").cache()
    asked, calls = ranked.select("query_id").distinct(), []

    def find(some, k):
        calls.append(some.count())
        return ranked.join(some, "query_id", "left_semi").where(F.col("rank") <= k)

    got = {q: [] for q in want}
    for r in hybrid.progressive(find, asked, spark.createDataFrame([("yes",)], "ref_id string"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.rank)
    assert got == want and calls[0] == 12 and calls == sorted(calls, reverse=True) and calls[-1] < 12


def test_hidden_assertions_are_never_returned(spark):
    rows = [(f"c{i}", f"R{i % 3}", "fine" if i % 2 else "coarse", "alpha " * (9 - i % 9) + f"w{i}", f"A{i}" if i % 4 else None) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, ref_id string, level string, payload string, assertion_id string")
    q = spark.createDataFrame([(1, "alpha"), (2, "w7 alpha")], "query_id long, text string")
    gone = spark.createDataFrame([(f"A{i}",) for i in range(0, 40, 3)], "assertion_id string")
    chunk_ids = {f"c{i}" for i in range(0, 40, 3) if i % 4}
    shown = hybrid.hybrid_retrieve(q, chunks, hidden=gone, fine_top_k=40, coarse_top_k=40).hits.collect()
    everything = hybrid.hybrid_retrieve(q, chunks, fine_top_k=40, coarse_top_k=40).hits.collect()
    pairs = lambda hits: {(r.query_id, r.chunk_id) for r in hits}
    assert pairs(shown) == {p for p in pairs(everything) if p[1] not in chunk_ids} and pairs(shown) != pairs(everything)
    restricted = hybrid.hybrid_retrieve(q, chunks, hidden=gone, allowed=spark.createDataFrame([(1, "R0"), (2, "R1")], "query_id long, ref_id string")).hits.collect()
    assert restricted and not {r.chunk_id for r in restricted} & chunk_ids
    with pytest.raises(ValueError, match="assertion_id"):
        hybrid.hybrid_retrieve(q, chunks.drop("assertion_id"), hidden=gone)
    found = spark.createDataFrame([(1, f"c{i}", "R", i + 1) for i in range(9)], "query_id long, chunk_id string, ref_id string, rank long")
    find = lambda some, k: found.join(some, "query_id", "left_semi").where(F.col("rank") <= k)
    with pytest.raises(ValueError, match="assertion_id"):
        hybrid.progressive(find, q, None, 3, hidden=gone)
    got = hybrid.progressive(find, q, None, 3, hidden=gone.selectExpr("replace(assertion_id, 'A', 'c') AS chunk_id"))
    assert sorted(r["rank"] for r in got.collect()) == [2, 3, 5, 6, 8, 9]


def test_requests_ask_for_their_own_depth_and_hide_assertions(spark):
    rows = [(f"{kind[0]}{i}", f"R{i}", kind, f"alpha w{i}", "p", f"A{i}") for i in range(8) for kind in ("coarse", "fine")]
    chunks = spark.createDataFrame(rows, "chunk_id string, ref_id string, level string, payload string, locator string, assertion_id string").withColumn("confidence", F.lit("high")).withColumn("evidence_type", F.lit(None).cast("string"))
    none = F.lit(None)
    req = spark.createDataFrame([(1, "alpha", 2, None), (2, "alpha", None, 3), (3, "alpha", None, None)], "request_id long, query string, top_k int, coarse_top_k int").select("*", *(none.cast("array<string>").alias(c) for c in ("subqueries", "coverage_keys", "required_coverage_keys", "allowed_ref_ids")), none.cast("boolean").alias("private_data_unauthorized"), none.cast("double").alias("calibrated_support"))
    hidden = spark.createDataFrame([("A0",)], "assertion_id string")
    got = evidence.retrieve(req, chunks, hidden=hidden, top_k=5)
    found = {}
    for r in got.records.collect():
        found.setdefault(r.request_id, set()).add(r.chunk_id)
    assert {k: len(v) for k, v in found.items()} == {1: 2, 2: 3, 3: 5} and "f0" not in set().union(*found.values())
    vectors_of = spark.createDataFrame([("f1", "R1", [1.0, 0.0])], "chunk_id string, ref_id string, embedding array<double>")
    with pytest.raises(ValueError, match="finite"):
        evidence.retrieve(req, chunks, vectors=vectors_of, embed=lambda rows: rows.select("query_id", F.array(F.lit(float("nan"))).alias("embedding")))


def test_block_search_equals_every_score(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [" ".join(rng.choices(words, k=rng.randrange(0, 40))) for _ in range(400)] + ["w1 w2 w3"] * 100
    chunks = spark.createDataFrame([(f"c{i:04d}", f"R{i % 50}", "fine" if i % 3 else "coarse", t) for i, t in enumerate(docs)], CHUNK).repartition(5)
    asked = {f"q{i}": " ".join(rng.choices([*words, "none"], k=rng.randrange(0, 8))) for i in range(30)} | {"q30": "w1 w2 w3 w3"}
    n, df = len(docs), {w: sum(w in t.split() for t in docs) for w in [*words, "none"]}
    avgdl = sum(len(t.split()) for t in docs) / n

    def score(q, t):
        t = t.split()
        return round(sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in q.split() if w in t), 9)

    def best(q, ok=lambda i: True):
        s = sorted((-score(q, t), f"c{i:04d}") for i, t in enumerate(docs) if ok(i) and score(q, t) > 0)
        return [c for _, c in s[:7]]

    q = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    search = bm25.searcher(q, chunks)
    old, bm25.BLOCK = bm25.BLOCK, 10
    try:
        for rows, ok in ((search.top(7), lambda i: True), (search.top(7, "coarse"), lambda i: i % 3 == 0), (search.top(7, None, chunks.where("ref_id < 'R2'")), lambda i: f"R{i % 50}" < "R2")):
            got = {k: [] for k in asked}
            for r in rows.orderBy("query_id", "rank").collect():
                got[r.query_id].append(r.chunk_id)
            assert got == {k: best(t, ok) for k, t in asked.items()}
        pairs = spark.createDataFrame([(k, f"R{j}") for k in asked for j in (3, 4)], "query_id string, ref_id string")
        got = {(r.query_id, r.chunk_id): r.score for r in search.pairs(pairs).collect()}
    finally:
        bm25.BLOCK = old
    want = {(k, f"c{i:04d}"): score(t, docs[i]) for k, t in asked.items() for i in range(len(docs)) if i % 50 in (3, 4) and score(t, docs[i]) > 0}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)


def test_a_stored_index_grows(spark, tmp_path):
    chunks = spark.createDataFrame([("A", "RA", "fine", "quick fox"), ("B", "RB", "fine", "lazy dog")], CHUNK)
    index = bm25.Index.store(chunks, f"{tmp_path}/ix")
    q = spark.createDataFrame([("x", "fox dog")], "query_id string, text string")
    assert [r.chunk_id for r in bm25.bm25_topk(q, index, 5).collect()] == ["A", "B"]
    index = bm25.Index.store(spark.createDataFrame([("0", "RC", "fine", "fox fox")], CHUNK), f"{tmp_path}/ix", mode="append")
    assert {r.chunk_id for r in bm25.bm25_topk(q, index, 5).collect()} == {"0", "A", "B"}
    han = spark.createDataFrame([("H", "RH", "fine", "膜污染 cleaning, pH7.5")], CHUNK)
    assert han.select(T.mixed_tokens(F.col("payload")).alias("t")).first().t == ["膜", "污", "染", "cleaning", ",", "pH7.5"]


def test_vector_ids_of_any_type_and_ties(spark):
    v = spark.createDataFrame([(f"c{i:03d}", f"R{i}", i % 3, [1.0, 0.0] if i % 2 else [0.5, 0.0]) for i in range(200)], "chunk_id string, ref_id string, label int, embedding array<float>").repartition(3)
    q = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 9, [1.0, 0.0]), ("n", 1, None)], "query_id string, label int, embedding array<float>")
    assert [r.chunk_id for r in vector.vector_topk(q, v, 3).where("query_id = 'a'").orderBy("rank").collect()] == ["c001", "c003", "c005"]
    assert [(r.query_id, r.chunk_id) for r in vector.vector_topk(q, v, 2, same_label=True).orderBy("rank").collect()] == [("a", "c001"), ("a", "c007")]


def test_numbers_as_text(spark):
    xs = [1.42, 0.0, -0.0, 1e-7, 2e-7, -1.5e-5, 0.0001, 0.00012345, 0.001, 1e7, 12345678.9, 123456789012345.6, 1e15, 1e16, -1.5e17, 1e22, 100.0, 5e-324, 1.7976931348623157e308, 0.1 + 0.2, 2e-3, 1e23, 2e23, 2.0**-44, 2.2250738585072014e-308, 9.999999999999999e22, 8.41e21, 5e-5, 1.0, -7.0, 9007199254740993.0]
    rng = random.Random(2)
    xs += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(63)))[0] for _ in range(3000)] + [rng.randrange(1, 10**6) * 10.0 ** rng.randrange(-20, 20) for _ in range(2000)]
    xs = [x for x in xs if math.isfinite(x)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(T.float_text(F.col("x"))).collect()
    assert [r[0] for r in got] == [repr(x) for x in xs]
    odd = spark.createDataFrame([(0, None), (1, float("nan")), (2, float("-inf"))], "i int, x double").orderBy("i").select(T.float_text(F.col("x"))).collect()
    assert [r[0] for r in odd] == [None, "nan", "-inf"]


def test_hashes_see_every_digit(spark):
    rows = [assertion("A", value_num=1e-7), assertion("A", value_num=2e-7), assertion("A", value_type="range", value_num=None, value_lo=1.0, value_hi=2.0), assertion("A", value_type="range", value_num=None, value_lo=100.0, value_hi=200.0), assertion("A", uncertainty=0.1), assertion("A")]
    a = assertions(spark, *rows)
    assert a.select(curation.assertion_hash(a)).distinct().count() == 6 and a.select(curation.slot_key(a)).distinct().count() == 2
    b = assertions(spark, assertion("A"), assertion("B", speculative_wording=True))
    assert b.select(curation.semantic_hash(b)).distinct().count() == 2 and a.limit(1).select(curation.material_hash(a)).first()[0] != a.limit(1).select(curation.assertion_hash(a)).first()[0]


def test_rerank_refuses_what_is_not_finite(spark):
    hits = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.9)], "query_id long, chunk_id string, s double")
    assert [r.chunk_id for r in fusion.rerank(hits, F.col("s")).orderBy("rank").collect()] == ["B", "A"]
    with pytest.raises(Exception, match="finite"):
        fusion.rerank(hits, F.lit(float("nan"))).collect()


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],)], "v array<float>").select(vectors.l2_normalize(F.col("v")).alias("n")).collect()
    assert [r.n for r in v] == [[0.6, 0.8], [0.0, 0.0], None]


# --- identifiers -------------------------------------------------------------------------------------------------------


def test_identifiers(spark):
    d = spark.createDataFrame([("doi:10.1000/XYZ",), ("https://doi.org/10.1000/xyz",), ("http://dx.doi.org/10.1000/xyz",), ("  10.1000/xyz ",), ("  ",), (None,)], "d string")
    assert [r[0] for r in d.select(T.work_doi(F.col("d"))).collect()] == ["10.1000/xyz"] * 4 + [None, None]
    assert [r[0] for r in d.select(T.cited_doi(F.col("d"))).collect()][:3] == ["doi:10.1000/xyz", "10.1000/xyz", "http://dx.doi.org/10.1000/xyz"]
    t = spark.createDataFrame([("Ａ  Ｓｔｕｄｙ",), ("Straße",), (" ",), (None,)], "t string")
    assert [r[0] for r in t.select(T.work_title(F.col("t"))).collect()] == ["a study", "strasse", None, None]


SOURCE = "seq long, ref_id string, source_fingerprint string, title string, doi string, stable_id string"


def test_intake_precedence(spark):
    history = [(1, "R1", "f1", "One", "10.1/a", "S1"), (2, "R2", "f2", "Two", None, "S2"), (3, "R1", "f1", "One", "10.1/a", "S1")]
    new = [(10, "R1", "f1", "One", "doi:10.1/A", None), (11, "R1", "f1", "One", "10.1/b", None), (12, "R9", "f9", "X", "10.1/a", None), (13, "R9", "f9", "X", "10.1/a", " S2 "), (14, "R9", "f9", "X", None, "S2"), (15, "R9", "f9", "ONE", None, None), (16, "R9", "f9", "Q", None, None)]
    reg = identity.register(identity.normalized(spark.createDataFrame(history, SOURCE)))
    got = {r.seq: r.disposition for r in identity.classify_intake(identity.normalized(spark.createDataFrame(new, SOURCE)), reg).collect()}
    assert got == {10: "exact_replay", 11: "identity_conflict", 12: "same_work_new_version", 13: "identity_conflict", 14: "same_work_new_version", 15: "review_required", 16: "new_work"}


def _one_after_the_other(rows, new_id, version_id):
    """The registry's rules on rows (seq, ref, fp, title, doi, sid, work, prior, relation, kind), in plain Python."""
    registry, out = [], {}
    for seq, ref, fp, title, doi, sid, work, prior, rel, kind in sorted(rows):
        by = lambda k, v: {r["work"] for r in registry if v is not None and r[k] == v}
        same = next((r for r in registry if (r["ref"], r["fp"]) == (ref, fp)), None)
        p = next((r for r in registry if r["id"] == prior), None) if prior else None
        known = work in {r["work"] for r in registry}
        d, s, t = by("doi", doi), by("sid", sid), by("title", title)
        stated = work is not None or prior is not None or rel not in (None, "none")
        target, why, disposition = work or (p and p["work"]), None, None
        relation = rel or ("revision_of" if prior else "explicit_same_work")
        if same:
            wrong = (work and (not known or work != same["work"])) or (prior and (p is None or p["work"] != same["work"] or prior != same["prior"])) or (rel and rel != same["rel"]) or (kind and same["kind"] and kind != same["kind"])
            wrong = wrong or any(x is not None and same[k] is not None and x != same[k] for k, x in (("doi", doi), ("sid", sid), ("title", title)))
            disposition, named = ("identity_conflict" if wrong else "exact_replay"), same["work"]
        elif len(d) > 1 or len(s) > 1 or (d and s and d != s):
            disposition, named = "identity_conflict", None
        elif stated:
            wrong = (rel == "none" and (work or prior)) or (not work and not prior) or (work and not known) or (prior and (p is None or (work and p["work"] != work))) or (d and d != {target}) or (s and s != {target})
            wrong = wrong or (relation in ("revision_of", "corrected_version", "preprint_to_journal") and not prior) or (relation == "preprint_to_journal" and (p["kind"] != "preprint" or kind != "journal"))
            disposition, named = ("identity_conflict", None) if wrong else ("same_work_new_version", target)
        elif d or s:
            disposition, named = "same_work_new_version", min(d or s)
        else:
            disposition, named = ("review_required", None) if t else ("new_work", None)
        out[seq] = (disposition, named)
        if disposition in ("new_work", "same_work_new_version"):
            w = named or new_id(ref, fp)
            registry.append({"id": version_id(ref, fp, w), "work": w, "ref": ref, "fp": fp, "doi": doi, "sid": sid, "title": title, "kind": kind, "prior": prior, "rel": rel or ("none" if disposition == "new_work" else "revision_of")})
    return out, registry


@pytest.mark.parametrize("seed", [1, 2])
def test_intake_in_order(spark, seed):
    import hashlib

    packed = lambda *x: hashlib.sha256(",".join(f"{len(v)}:{v}" for v in x).encode()).hexdigest()[:16]
    new_id, version_id = (lambda r, f: packed("new_work", r, f)), packed
    rng, rows = random.Random(seed), []
    for seq in range(80):
        ref, fp = f"R{rng.randrange(30)}", f"f{rng.randrange(2)}"
        some = lambda p, x: x if rng.random() < p else None
        work = some(0.15, new_id(f"R{rng.randrange(30)}", f"f{rng.randrange(2)}") if rng.random() < 0.8 else "W-none")
        prior = some(0.1, version_id(f"R{(k := rng.randrange(30))}", "f0", new_id(f"R{k}", "f0")) if rng.random() < 0.8 else "SV-none")
        rel = some(0.2, rng.choice(["none", "revision_of", "explicit_same_work", "preprint_to_journal"]))
        rows.append((seq, ref, fp, some(0.4, rng.choice(["a", "b", "c", "d"])), some(0.5, rng.choice(["10.1/hot", "10.1/x", f"10.1/{seq % 7}"])), some(0.4, f"S{rng.randrange(5)}"), work, prior, rel, some(0.8, rng.choice(["journal", "preprint"]))))
    df = spark.createDataFrame(rows, "seq long, ref_id string, source_fingerprint string, title string, doi string, stable_id string, explicit_work_id string, explicit_prior_version_id string, explicit_relation string, source_kind string")
    ready = identity.normalized(df, T.ascii_work_title(F.col("title")))
    decisions, registry = identity.intake_in_order(ready, identity.register(ready.limit(0)))
    want, registered = _one_after_the_other(rows, new_id, version_id)
    assert {r.seq: (r.disposition, r.work_id) for r in decisions.collect()} == want
    assert sorted((r.source_version_id, r.work_id) for r in registry.collect()) == sorted((r["id"], r["work"]) for r in registered)
    assert {d for d, _ in want.values()} == {"identity_conflict", "exact_replay", "same_work_new_version", "review_required", "new_work"}


def test_intake_of_a_chain_and_of_one_hot_key(spark, monkeypatch):
    """Thousands of rows of one DOI, each linked to others through its stable id, take a few rounds; of two new ones the second
    is a version of the first's work, and works that meet through both ids conflict."""
    rounds = []
    real = identity.classify_intake
    monkeypatch.setattr(identity, "classify_intake", lambda *a: rounds.append(1) or real(*a))
    rows = spark.range(3000).select(F.col("id").alias("seq"), F.concat(F.lit("R"), "id").alias("ref_id"), F.lit("f").alias("source_fingerprint"), F.lit(None).cast("string").alias("title"), F.when(F.col("id") % 3 != 1, "10.1/hot").alias("doi"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("S"), (F.col("id") / 3).cast("int"))).alias("stable_id"))
    ready = identity.normalized(rows, T.ascii_work_title(F.col("title")))
    decisions, _ = identity.intake_in_order(ready, identity.register(ready.limit(0)))
    got = {r.disposition: r.n for r in decisions.groupBy("disposition").agg(F.count("*").alias("n")).collect()}
    assert got == {"new_work": 1001, "same_work_new_version": 999, "identity_conflict": 1000} and len(rounds) <= 4


def test_whole_texts_are_normalised_as_titles(spark, tmp_path):
    import unicodedata

    from evidence_spark.plans.catalogue import QUERIES

    texts = [None, "", " \t\u3000", "x" * 79 + " Ｆｕｌｌ  Straße\n ﬁn ", "A  Study\u00a0Of " * 40, "é" * 100 + "E\u0301Ǆ"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sf = "/root/testdata/sf0.001"
    for d, rows in ((str(tmp_path), dict(enumerate(texts))), (sf, {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})):
        want = {i: " ".join(unicodedata.normalize("NFKC", t or "").split()).casefold() or None for i, t in rows.items()}
        assert {r.doc_id: r.title for r in QUERIES["normalize_title_nfkc"](spark, d).collect()} == want


# --- deltas ------------------------------------------------------------------------------------------------------------


def test_alignment_and_transitions(spark):
    unit = "pair_id long, unit_id string, content_hash string, prior_unit_id string"
    prior = spark.createDataFrame([(1, "U1", "h1", None), (1, "OLD", "h2", None), (1, "U3", "h3", None), (1, "U4", "h4", None), (1, "U6", "h6", None), (2, "U1", "h1", None), (3, "V", "v", None)], unit)
    new = spark.createDataFrame([(1, "U1", "h1", None), (1, "NEW", "h2", "OLD"), (1, "U3", "x", None), (1, "U5", "h5", None), (1, "U6", "y", None), (2, "U9", "h1", None), (3, "V", "v", None)], unit)
    aligned = delta.align_units(prior, new)
    assert {(r.pair_id, r.prior_unit, r.unit): r.category for r in aligned.where("pair_id < 3").collect()} == {(1, "U1", "U1"): "unchanged", (1, "OLD", "NEW"): "unchanged", (1, "U3", "U3"): "modified", (1, "U6", "U6"): "modified", (1, "U4", None): "removed", (1, None, "U5"): "added", (2, "U1", None): "removed", (2, None, "U9"): "added"}
    cols = "pair_id long, unit_id string, assertion_id string, slot_key string, payload_hash string"
    pa = spark.createDataFrame([(1, "OLD", "A1", "s", "p"), (1, "U3", "A2", "s", "p"), (1, "U3", "A3", "t", "p"), (1, "U4", "A5", "s", "p"), (1, "U6", "A6", "s", "p"), (1, "U6", "A7", "s", "p"), (1, "U6", "A8", "t", "p"), (2, "U1", "B1", "s", "p"), (3, "GONE", "C1", "s", "p")], cols)
    na = spark.createDataFrame([(1, "U3", "N2", "s", "q"), (1, "U3", "N6", "v", "q"), (1, "U5", "N5", "s", "q"), (1, "U6", "N7", "t", "q"), (2, "U9", "D1", "s", "p"), (3, "V", "C2", "s", "p")], cols)
    plan = delta.delta_plan(aligned, delta.unsafe_pairs(prior, pa))
    # That nothing aligns is no reason to extract all anew; that an assertion's unit is unknown is one.
    assert {r.pair_id: (r.mode, r.reason, r.extract) for r in plan.collect()} == {1: ("delta_safe", None, ["U3", "U5", "U6"]), 2: ("delta_safe", None, ["U9"]), 3: ("full_reextract_required", "unresolved_unit", ["V"])}
    assert delta.delta_plan(aligned, delta.unsafe_pairs(prior, pa, spark.createDataFrame([(3,), (2,)], "pair_id long"))).where("reason = 'segmentation_reset'").count() == 2
    moves = delta.transitions(aligned, pa, na, plan)
    got = {(r.action, r.old_id, r.new_id if r.old_id != "A1" else "carried") for r in moves.collect()}
    assert got == {("supersede", "A1", "carried"), ("supersede", "A2", "N2"), ("archive", "A3", None), ("added", None, "N6"), ("archive", "A5", None), ("added", None, "N5"), ("review_required", None, None), ("archive", "B1", None), ("added", None, "D1"), ("archive", "C1", None), ("added", None, "C2")}
    clash = spark.createDataFrame([(1, "a", "h", "OLD"), (1, "b", "h", "OLD"), (1, "c", "h", "GONE"), (1, "c", "h", None)], unit)
    errors = delta.alignment_errors(prior, clash)
    assert {(r.unit, r.error) for r in errors.collect()} == {("OLD", "claimed_twice"), ("GONE", "unknown_prior"), ("c", "repeated_unit")}
    assert delta.valid_pairs(delta.align_units(prior, clash), errors).where("pair_id = 1").isEmpty()
    done = spark.createDataFrame([(1, "U3"), (1, "U5"), (1, "U1")], "pair_id long, unit_id string")
    batch = spark.createDataFrame([(1, "U3", "x"), (1, "U3", "x"), (1, None, "y"), (1, "ZZ", "z"), (1, "U6", "w")], "pair_id long, unit_id string, assertion_id string")
    found = {(r.id, r.error) for r in delta.batch_errors(batch, done, plan.where("pair_id = 1"), new).collect()}
    assert found == {("x", "repeated_id"), ("y", "no_unit"), ("z", "unknown_unit"), ("w", "unit_not_processed"), ("U6", "processed_differs_from_plan"), ("U1", "processed_differs_from_plan")}


# --- lifecycle ---------------------------------------------------------------------------------------------------------


def test_states_as_of_a_version(spark):
    versions = spark.createDataFrame([("v1", None), ("v2", "v1"), ("v3", "v2"), ("w3", "v2"), ("x", "y"), ("y", "x")], "version_id string, prior_version_id string")
    up = {}
    for r in lifecycle.ancestors(versions).collect():
        up.setdefault(r.version_id, set()).add(r.ancestor_id)
    assert up == {"v1": {"v1"}, "v2": {"v1", "v2"}, "v3": {"v1", "v2", "v3"}, "w3": {"v1", "v2", "w3"}, "x": {"x", "y"}, "y": {"x", "y"}}
    rec = spark.createDataFrame([("l1", "R", "retracted", "r", "v2", 1), ("l2", "R", "active", "r", "v3", 2), ("l3", "R", "archived", "r", None, 3), ("l4", "Q", "superseded", "r", "w3", 4)], "lifecycle_id string, ref_id string, status string, reason string, effective_version_id string, created_seq long")
    got = {(r.version_id, r.ref_id): r.status for r in lifecycle.state_as_of(rec, versions, versions).collect()}
    assert got == {("v2", "R"): "retracted", ("v3", "R"): "active", ("w3", "R"): "retracted", ("w3", "Q"): "superseded"}
    seen = {r.ref_id: r.visible for r in lifecycle.eligibility(spark.createDataFrame([("R",), ("Q",), ("Z",)], "ref_id string"), lifecycle.latest_state(rec)).collect()}
    assert seen == {"R": True, "Q": False, "Z": True}
    seq = lifecycle.assign_sequence(spark.createDataFrame([(5,), (3,), (9,)], "k long"), ["k"], 10).collect()
    assert {r.k: r.created_seq for r in seq} == {3: 11, 5: 12, 9: 13}


# --- claims ------------------------------------------------------------------------------------------------------------


def test_long_chains_of_versions(spark):
    n = 2000
    versions = spark.range(n).select(F.concat(F.lit("v"), "id").alias("version_id"), F.when(F.col("id") > 0, F.concat(F.lit("v"), F.col("id") - 1)).alias("prior_version_id"))
    at = spark.createDataFrame([(f"v{n - 1}",), ("v7",)], "version_id string")
    up = lifecycle.ancestors(versions, at)
    assert up.groupBy("version_id").agg(F.count("*"), F.max("distance")).orderBy("version_id").collect() == [("v1999", n, n - 1), ("v7", 8, 7)]
    assert len(up._jdf.queryExecution().toString()) < 5000  # a read of one table


def _versions(spark, *pairs):
    return spark.createDataFrame(list(pairs), "version_id string, prior_version_id string")


def test_positions_in_random_version_trees(spark):
    rng = random.Random(5)
    prior = {f"v{i}": rng.choice([None, "gone", f"v{i}", *([f"v{rng.randrange(i)}"] * 9 if i else [])]) for i in range(120)}
    prior = {v: None if p == v else p for v, p in prior.items()}
    extra = [("v3", prior["v3"]), (None, "v1"), ("v0", "v0")] if prior["v0"] is None else [("v3", prior["v3"]), (None, "v1")]
    places = versions.labels(_versions(spark, *prior.items(), *extra))
    got = {r.version_id: r for r in places.withColumn("n", versions.descendants()).collect()}
    prior["gone"] = None
    line = {v: [v] for v in prior}
    for v in prior:
        while prior[line[v][-1]]:
            line[v].append(prior[line[v][-1]])
    assert got.keys() == line.keys()
    for v, r in got.items():
        assert (r.tree, r.depth, r.n) == (line[v][-1], len(line[v]) - 1, sum(v in x for x in line.values()) - 1)
        for a, q in got.items():
            assert (a in line[v]) == (q.tree == r.tree and q.first <= r.first and r.last <= q.last)
    rec = [(f"l{i}", rng.choice(["R", "Q", None]), rng.choice(["active", "retracted"]), None, rng.choice([*prior, "unknown", None]), rng.choice([1, 2, 3, None])) for i in range(150)]
    records = spark.createDataFrame(rec, "lifecycle_id string, ref_id string, status string, reason string, effective_version_id string, created_seq long")
    stretches = versions.timeline(records, places)
    want = {}
    for v in line:
        for l, key, status, _, bound, seq in rec:  # noqa: E741
            if key and bound in line[v]:
                want[v, key] = max(want.get((v, key), ()), (seq is not None, seq or 0, l, status))
    found = versions.states_at(stretches, places).collect()
    assert len(found) == len(want) and {(r.version_id, r.ref_id): (r.created_seq is not None, r.created_seq or 0, r.lifecycle_id, r.status) for r in found} == want
    assert stretches.count() <= 2 * len(rec)
    some = places.where("version_id in ('v7', 'v77')")
    assert {(r.version_id, r.ref_id) for r in versions.states_at(stretches, some).collect()} == {k for k in want if k[0] in ("v7", "v77")}


def test_odd_version_trees(spark):
    empty = versions.labels(_versions(spark))
    records = spark.createDataFrame([("l", 7, "active", None, "v1", 1)], "lifecycle_id string, ref_id long, status string, reason string, effective_version_id string, created_seq long")
    assert empty.collect() == [] and versions.states_at(versions.timeline(records, empty), empty).collect() == []
    with pytest.raises(ValueError, match="v1 has two priors"):
        versions.labels(_versions(spark, ("v1", "a"), ("v1", "b")))
    with pytest.raises(ValueError, match="their own ancestors"):
        versions.labels(_versions(spark, ("r", None), ("x", "y"), ("y", "x"), ("z", "x")))
    one = versions.labels(_versions(spark, ("v1", "v1")))
    assert [(r.ref_id, r.status) for r in versions.states_at(versions.timeline(records, one), one).collect()] == [(7, "active")]


def test_a_hundred_thousand_versions_without_a_closure(spark):
    n = 100_000
    chain = spark.range(n).select(F.concat(F.lit("v"), "id").alias("version_id"), F.when(F.col("id") > 0, F.concat(F.lit("v"), F.col("id") - 1)).alias("prior_version_id"))
    places = versions.labels(chain)
    assert places.agg(F.count("*"), F.max("depth"), F.count_distinct("tree"), F.sum("depth")).first() == (n, n - 1, 1, n * (n - 1) // 2)
    records = spark.createDataFrame([("a", "R", "active", None, "v10", 1), ("b", "R", "retracted", None, "v60000", 2)], "lifecycle_id string, ref_id string, status string, reason string, effective_version_id string, created_seq long")
    at = versions.states_at(versions.timeline(records, places), places)
    assert {r.status: r["count"] for r in at.groupBy("status").count().collect()} == {"active": 59_990, "retracted": 40_000}


def test_binding_lifecycle_records(spark):
    rec = spark.createDataFrame([("l1", "R", "retracted", "r", None, 1), ("l2", "Q", "active", "r", "v1", 2)], "lifecycle_id string, ref_id string, status string, reason string, effective_version_id string, created_seq long")
    bind = lambda *b: lifecycle.bind_effective_version(rec, spark.createDataFrame(list(b), "lifecycle_id string, version_id string"))
    assert {r.lifecycle_id: r.effective_version_id for r in bind(("l1", "v2"), ("l2", "v1")).collect()} == {"l1": "v2", "l2": "v1"}
    for wrong in (("l2", "v9"), ("l3", "v1")):
        with pytest.raises(Exception, match="lifecycle record"):
            bind(wrong).collect()


def test_ranges_and_confidence(spark):
    cases = [([(1.0, 2.0), (5.0, 6.0)], True), ([(5.0, 6.0), (1.0, 5.5)], False), ([(1.0, 9.0), (2.0, 3.0), (4.0, 5.0)], True), ([(1.0, 3.0), (2.0, 9.0), (4.0, 5.0)], False), ([(1.0, 2.0)], False), ([], False)]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, r array<struct<lo: double, hi: double>>")
    assert [r[0] for r in df.orderBy("i").select(intervals.ranges_disjoint(F.col("r"))).collect()] == [x for _, x in cases]


def test_claims(spark):
    rec = spark.createDataFrame([(1, 1, "c1", "R1", "p.1", "high", "literature", [], "x", True), (1, 2, "c2", "R2", "p.9", "medium", "literature", [], "x", True), (1, 3, "c3", "R3", "p.1", "high", "graph", [], "x", False)], "query_id long, rank long, chunk_id string, ref_id string, locator string, confidence string, evidence_type string, reasons array<string>, excerpt string, guardable boolean")
    claim = "claim_id string, query_id long, anchor_chunk_ids array<string>, numeric_source_ranges array<struct<lo: double, hi: double>>, is_critical_numeric boolean, coverage_key string, private_data_unauthorized boolean, mechanism_supported boolean, calibrated_support double, cited_ref_id string, cited_doi string, cited_title string, assertion_id string"
    rows = [
        ("high", 1, ["c1"], None, False, None, False, None, 1.0, "R1", "https://doi.org/10.1/A", "other", None), ("medium", 1, ["c1", "c2"], None, False, "k1", False, None, 1.0, "R2", "doi:10.1/b", None, "bad"),
        ("unknown", 1, ["zz", "c3"], None, True, None, False, None, 1.0, None, None, None, "good"), ("private", 1, ["c1"], None, False, "k2", True, False, 0.1, None, None, None, None),
    ]
    claims, meta = spark.createDataFrame(rows, claim), spark.createDataFrame([("R1", "A Title", "10.1/a"), ("R3", None, None)], "ref_id string, title string, doi string")
    anchors = guard.bind_anchors(claims, rec)
    policies = guard.claim_policy(claims, anchors)
    assert {r.claim_id: r.policy for r in policies.collect()} == {"high": "factual_allowed", "medium": "caveated_only", "unknown": "abstain", "private": "factual_allowed"}
    covered = spark.createDataFrame([(1, "k1")], "query_id long, coverage_key string")
    assert {r.claim_id: (r.abstain, r.reasons) for r in guard.claim_abstain(claims, policies, covered).collect()} == {
        "high": (False, []), "medium": (False, []), "unknown": (True, ["critical_numeric_only_hypothesis_or_pending"]), "private": (True, ["private_data_unauthorized", "low_retrieval_support", "subquestion_not_covered", "unsupported_inference_no_mechanism"]),
    }
    locators = spark.createDataFrame([("R1", " p.1"), ("R2", "p.1")], "ref_id string, locator string")
    h1 = {(r.claim_id, r.finding, r.ref_id) for r in guard.hallucination_h1(claims, anchors, meta, locators).collect()}
    assert h1 == {("medium", "ref_not_resolvable", "R2"), ("medium", "locator_absent", "R2"), ("unknown", "no_anchor", None)}
    assert {(r.claim_id, r.finding) for r in guard.hallucination_h2(claims, anchors, meta).collect()} == {("high", "title_mismatch"), ("medium", "ref_not_found")}
    assert {r.claim_id: r.h2_status for r in guard.h2_status(claims, meta).collect()} == {"high": "checked", "medium": "metadata_unavailable", "unknown": "checked", "private": "checked"}
    h3 = {r.claim_id: (r.h3_status, r.violated) for r in guard.hallucination_h3(claims, spark.createDataFrame([("bad",)], "id string")).collect()}
    assert h3 == {"high": ("not_checked", False), "medium": ("checked", True), "unknown": ("checked", False), "private": ("not_checked", False)}
    assert guard.answer(rec, spark.createDataFrame([(1,), (2,)], "query_id long")).orderBy("query_id").select("status", "anchors").collect() == [("answered", "c1"), ("abstain", "")]


# --- tasks, codecs, stores, streams ------------------------------------------------------------------------------------


def test_task_votes(spark):
    texts = [("search evidence", "RETRIEVE"), ("publish and find", "REVISION_PUBLICATION"), ("commit lookup", "CURATION_COMMIT"), ("curation_commit ", "CURATION_COMMIT"), ("撤稿", "REVISION_PUBLICATION"), ("hello", None), (" ", None), (None, None)]
    got = tasks.classify(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "task_id long, text string"))
    assert [r.task_type for r in got.orderBy("task_id").collect()] == [x for _, x in texts]
    assert [r.step for r in tasks.plan(got.where("task_id = 0")).orderBy("position").collect()] == ["step-1-retrieve"]
    assert [(r.step, r.depends_on) for r in tasks.plan(got.where("task_id = 2")).orderBy("position").collect()] == [("step-1-retrieve", None), ("step-2-curation", "step-1-retrieve"), ("step-3-commit", "step-2-curation")]


def test_workflow_stops_and_resumes():
    done, broken = [], [True]

    def second(_):
        if broken[0]:
            raise ValueError("down")
        done.append("b")

    steps = [tasks.Step("a", lambda _: done.append("a")), tasks.Step("b", second, ("a",)), tasks.Step("c", lambda _: done.append("c"), ("b",))]
    state = tasks.execute(steps)
    assert (state.status, state.failed, done) == ("FAILED", "b", ["a"])
    broken[0] = False
    assert tasks.execute(steps, state).status == "COMPLETED" and done == ["a", "b", "c"]
    assert tasks.execute([steps[2]]).error == "needs b"


def test_decoding(spark):
    ok = {"id": "1", "subject": {"original_mention": "Nafion"}, "property": "p", "object": {"value": 1.5, "unit": "V"}}
    rows = [("a", json.dumps(ok)), ("b", json.dumps(ok | {"object": {"value": [2, 1], "value_type": "range"}, "confidence": "high"})), ("c", json.dumps(ok | {"claim_type": "guess"})), ("d", "{nope"), ("e", json.dumps(ok | {"id": ""}))]
    good, bad = codec.decode_assertions(spark.createDataFrame(rows, "ref_id string, json string"))
    g = {r.ref_id: r for r in good.collect()}
    assert (g["a"].value_num, g["a"].confidence, g["a"].claim_type, g["a"].quality) == (1.5, "medium", "measurement", 0.5)
    assert (g["b"].value_lo, g["b"].value_hi, g["b"].confidence) == (2.0, 1.0, "high")
    assert {r.ref_id: r.errors for r in bad.collect()} == {"c": ["invalid:claim_type"], "d": ["not_json", "missing:id", "missing:subject.original_mention", "missing:property"], "e": ["missing:id"]}
    assert codec.decode_assertions(spark.createDataFrame(rows[:2], "ref_id string, json string"), strict=True)[0].isEmpty()
    r = codec.decode_requests(spark.createDataFrame([(1, '{"query": "q", "subqueries": ["a", "b"], "allowed_ref_ids": []}')], "request_id long, json string")).first()
    assert (r.coverage_keys, r.required_coverage_keys, r.allowed_ref_ids, r.top_k, r.coarse_top_k) == (["sq1", "sq2"], ["sq1", "sq2"], None, 5, 10)
    c = codec.decode_claims(spark.createDataFrame([(1, '{"claim_id": "c", "text": "t", "cited": {"ref_id": "R"}}')], "query_id long, json string")).first()
    assert (c.claim_id, c.anchor_chunk_ids, c.cited_ref_id, c.is_critical_numeric) == ("c", [], "R", False)


def test_commits_versions_and_rollback(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/kb", fail_at="publish")
    a = assertions(spark, assertion("A1"), assertion("A2"))
    with pytest.raises(RuntimeError):
        store.commit("R1", "f1", a)
    assert store.current() is None and store.table("versions").isEmpty()
    first = store.commit("R1", "f1", a)
    assert first.status == "published" and store.current() == first.version_id and store.resolve().count() == 2
    assert store.commit("R1", "f1", a.limit(1)).status == "idempotent_hit" and store.table("versions").count() == 1
    second = store.commit("R2", "f2", assertions(spark, assertion("B1", "R2")))
    assert {r.ref_id for r in store.knowledge_base().collect()} == {"R1", "R2"}
    store.rollback(first.version_id)
    assert store.current() == first.version_id and {r.ref_id for r in store.knowledge_base().collect()} == {"R1"}
    third = store.commit("R3", "f3", assertions(spark, assertion("C1", "R3")))
    assert {r.ref_id for r in store.knowledge_base(third.version_id).collect()} == {"R1", "R3"} and second.version_id != third.version_id
    made_of = lambda rows: {(r.version_id, r.part): r.n for r in rows.groupBy("version_id", "part").agg(F.count("*").alias("n")).collect()}
    sizes = {first.version_id: 2, second.version_id: 1, third.version_id: 1}
    assert made_of(store.resolve_all()) == {(v, part): 1 if part == "usdo" else n for v, n in sizes.items() for part in ("structural", "usdo", "vectors")}
    asked = spark.createDataFrame([(second.version_id,), ("kbv-9999",), (None,)], "version_id string")
    assert {v for v, _ in made_of(store.resolve_all(asked))} == {second.version_id} and Store(spark, f"{tmp_path}/none").resolve_all().isEmpty()
    with pytest.raises(ValueError, match="no published version"):
        store.rollback("kbv-9999")
    with pytest.raises(PermissionError):
        store.retract("R1", "retraction", verified_trigger=False)
    store.retract("R1", "retraction", True)
    store.retract("R1", "retraction", True)
    assert store.table("lifecycle").count() == 1 and store.table("outbox").where("event_type = 'document_retracted'").count() == 1


@pytest.mark.parametrize("fail_at", ["usdo", "publish", "pointer", "finalize"])
def test_a_commit_goes_on_where_it_stopped(spark, tmp_path, fail_at):
    whole, broken = Store(spark, f"{tmp_path}/whole"), Store(spark, f"{tmp_path}/broken", fail_at=fail_at)
    sources = spark.createDataFrame([("R1", "f1"), ("R2", "f2")], "ref_id string, fingerprint string")
    a = assertions(spark, assertion("A1"), assertion("A2"), assertion("B1", "R2"))
    with pytest.raises(RuntimeError):
        broken.commit_all(sources, a)
    want, got = whole.commit_all(sources, a), broken.commit_all(sources, a)
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect())) and {r.status for r in got.collect()} == {"published"}
    for t in ("snapshots", "versions", "pointer"):
        assert sorted(map(tuple, whole.table(t).collect())) == sorted(map(tuple, broken.table(t).collect()))
    assert broken.current() == "kbv-0002" and broken.resolve().count() == 1 and broken.resolve("kbv-0001").count() == 2


def test_a_failing_vector_port_leaves_the_commit_pending(spark, tmp_path):
    store, down = Store(spark, f"{tmp_path}/kb"), [True]

    def embed(rows):
        if down[0]:
            raise OSError("no embedder")
        return rows.select("vector_id", "ref_id", "assertion_id", "content_hash", F.array(F.lit(1.0)).alias("embedding"))

    a = assertions(spark, assertion("A1"))
    assert store.commit("R1", "f1", a, embed).status == "pending_vector" and store.current() is None and store.table("versions").isEmpty()
    store.sweep()
    down[0] = False
    done = store.commit("R1", "f1", a, embed)
    assert done.status == "published" and store.current() == done.version_id
    store.sweep()
    assert store.resolve().count() == 1


def test_two_fingerprints_and_documents_without_assertions(spark, tmp_path):
    store, a = Store(spark, f"{tmp_path}/kb"), assertions(spark, assertion("A1"))
    frame = lambda *rows: spark.createDataFrame(list(rows), "ref_id string, fingerprint string")
    with pytest.raises(ConflictError):
        store.commit_all(frame(("R1", "f1"), ("R1", "f2")), a)
    assert store.table("commits").isEmpty()
    for want in ("published", "idempotent_hit"):
        got = {r.ref_id: r.status for r in store.commit_all(frame(("R1", "f1"), ("R1", "f1"), ("R2", "f2")), a).collect()}
        assert got == {"R1": want, "R2": "nothing_admitted"}
    assert {r.ref_id: r.status for r in store.commit_states().collect()} == {"R1": "published"} and store.commit("R2", "f2", a).status == "nothing_admitted"


def test_one_bad_document_does_not_hold_back_the_others(spark, tmp_path):
    store, bad = Store(spark, f"{tmp_path}/kb"), ["R2"]
    embed = lambda rows: rows.select("vector_id", "ref_id", "assertion_id", "content_hash", F.when(F.col("ref_id").isin(bad), "not finite").alias("error"))
    sources = spark.createDataFrame([("R1", "f1"), ("R2", "f2"), ("R3", "f3")], "ref_id string, fingerprint string")
    a = assertions(spark, assertion("A1"), assertion("B1", "R2"), assertion("B2", "R2"), assertion("C1", "R3"))
    assert {r.ref_id: r.status for r in store.commit_all(sources, a, embed).collect()} == {"R1": "published", "R2": "pending_vector", "R3": "published"}
    assert {r.ref_id: (r.status, r.error) for r in store.commit_states().collect()} == {"R1": ("published", None), "R2": ("pending_vector", "not finite"), "R3": ("published", None)}
    store.sweep()
    bad.clear()
    assert {r.ref_id: (r.status, r.version_id) for r in store.commit_all(sources, a, embed).collect()} == {"R1": ("idempotent_hit", "kbv-0001"), "R2": ("published", "kbv-0003"), "R3": ("idempotent_hit", "kbv-0002")}
    assert store.resolve("kbv-0001").count() == 1 and store.resolve("kbv-0003").count() == 2


@pytest.mark.parametrize(("fail_at", "status"), [("vectors", "pending_vector"), ("snapshot", "pending_finalize"), ("publish", "pending_finalize"), ("pointer", "pending_finalize"), ("finalize", "pending_finalize")])
def test_states_after_a_failure_and_a_retry_in_another_set(spark, tmp_path, fail_at, status):
    """Documents whose commit stopped are published by a call with other documents; sweeping then removes nothing that is read."""
    store = Store(spark, f"{tmp_path}/kb", fail_at=fail_at)
    frame = lambda *rows: spark.createDataFrame(list(rows), "ref_id string, fingerprint string")
    a = assertions(spark, assertion("A1"), assertion("B1", "R2"), assertion("C1", "R3"))
    try:
        store.commit_all(frame(("R1", "f1"), ("R2", "f2")), a)
    except RuntimeError:
        assert fail_at != "vectors"
    assert {r.ref_id: r.status for r in store.commit_states().collect()} == {"R1": status, "R2": status}
    assert {r.status for r in store.commit_all(frame(("R1", "f1"), ("R3", "f3")), a).collect()} == {"published"}
    store.sweep()
    for r in store.table("versions").collect():
        assert [x.ref_id for x in store.resolve(r.version_id).collect()] == [r.ref_id]
    assert store.commit("R2", "f2", a).status == "published" and {r.ref_id for r in store.knowledge_base().collect()} == {"R1", "R2", "R3"}


def test_append_once_refuses_two_materials_of_one_key(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/kb")
    rows = lambda *r: spark.createDataFrame(list(r), "lifecycle_id string, ref_id string, status string, reason string, effective_version_id string, created_seq long")
    one = ("l", "R", "active", "x", None, 1)
    with pytest.raises(ConflictError):
        store.append_once("lifecycle", rows(one, ("l", "R", "retracted", "x", None, 1)), "lifecycle_id", ["ref_id", "status"])
    assert store.append_once("lifecycle", rows(one, one), "lifecycle_id", ["ref_id", "status"]) == 1
    assert store.append_once("lifecycle", rows(one), "lifecycle_id", ["ref_id", "status"]) == 0


@pytest.mark.parametrize("fail_at", [None, "pointer", "event", "finalized"])
def test_publication_goes_on_where_it_stopped(spark, tmp_path, fail_at):
    store = Store(spark, f"{tmp_path}/kb")
    store.commit("R1", "f1", assertions(spark, assertion("A1")))
    moves = spark.createDataFrame([("supersede", "A1", "A1N")], "action string, old_id string, new_id string")
    publish = lambda scope="s": store.publish_revision("pkg", "R1", "f2", assertions(spark, assertion("A1N")), moves, scope, "s")
    with pytest.raises(PermissionError):
        publish(None)
    with pytest.raises(PermissionError):
        publish("other")
    store.fail_at = fail_at
    if fail_at:
        with pytest.raises(RuntimeError):
            publish()
    pub = publish()
    assert store.publication_phase(pub) == "finalized" and publish() == pub
    assert store.table("versions").count() == 2 and store.table("lifecycle").count() == 1 and store.table("outbox").count() == 1
    assert [(r.assertion_id, r.superseded_by) for r in store.table("assertion_lifecycle").collect()] == [("A1", "A1N")]
    assert [(r.old_version_id, r.new_version_id) for r in store.table("outbox").collect()] == [("kbv-0001", "kbv-0002")]


def test_outbox_delivers_each_event_once(spark, tmp_path):
    schema, seen = "event_id long, kind string", []
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        events = outbox.deduplicated(outbox.read_outbox(spark, f"{tmp_path}/in", schema))
        outbox.deliver(events, f"{tmp_path}/state", lambda b, _: seen.extend(r.event_id for r in b.collect())).awaitTermination()

    write([(1, "a"), (2, "a"), (1, "a")])
    run()
    write([(2, "a"), (3, "a")])
    run()
    run()
    assert sorted(seen) == [1, 2, 3]


def test_engine(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "R1", "coarse", "alpha", "summary", "high", None), ("f1", "R1", "fine", "beta alpha", "p.1", "high", None)], CHUNK + ", locator string, confidence string, evidence_type string")
    e = Engine(spark, chunks=chunks, existing=assertions(spark), store=Store(spark, f"{tmp_path}/kb"))
    assert e.health()["vectors"] == "unavailable" and e.health()["chunks"] == "ready"
    q = spark.createDataFrame([(1, "alpha"), (2, "nothing")], "query_id long, text string")
    assert [(r.query_id, r.status) for r in e.answer(q).orderBy("query_id").collect()] == [(1, "answered"), (2, "abstain")]
    out = e.curate_and_commit(documents(spark, document("R1"), document("R2", "D")), assertions(spark, assertion("A1"), assertion("B1", "R2")), {"R1": "f1", "R2": "f2", "R3": "f3"})
    assert out["R1"].status == "published" and out["R2"] == "all_rejected" and out["R3"] == "unknown_document"
    with pytest.raises(RuntimeError, match="unavailable"):
        Engine(spark).retrieve(q)


def test_engine_answers_as_of_a_version(spark, tmp_path):
    """A retracted document and a superseded assertion are hidden from their version on, and seen as of the one before."""
    store = Store(spark, f"{tmp_path}/kb")
    store.commit("R1", "f1", assertions(spark, assertion("A1"), assertion("A2")))
    first = store.commit("R2", "f2", assertions(spark, assertion("B1", "R2"))).version_id
    moves = spark.createDataFrame([("supersede", "A1", "A1N")], "action string, old_id string, new_id string")
    store.revise("R1", "f3", assertions(spark, assertion("A1N")), moves)
    store.retract("R2", "retraction", True)
    rows = [(f"{level[0]}{a}", ref, level, f"alpha {a}", "p", a) for ref, a in (("R1", "A1"), ("R1", "A2"), ("R2", "B1")) for level in ("coarse", "fine")]
    chunks = spark.createDataFrame(rows, "chunk_id string, ref_id string, level string, payload string, locator string, assertion_id string").withColumn("confidence", F.lit("high")).withColumn("evidence_type", F.lit(None).cast("string"))
    e, none = Engine(spark, chunks=chunks, store=store), F.lit(None)
    req = spark.createDataFrame([(1, "alpha")], "request_id long, query string").select("*", *(none.cast("array<string>").alias(c) for c in ("subqueries", "coverage_keys", "required_coverage_keys", "allowed_ref_ids")), none.cast("boolean").alias("private_data_unauthorized"), none.cast("double").alias("calibrated_support"))
    seen = lambda at: {r.chunk_id for r in e.evidence(req, at).records.collect()}
    assert seen(None) == {"fA2"} and seen(first) == {"fA1", "fA2", "fB1"}
    with pytest.raises(ValueError, match="no published version"):
        e.evidence(req, "kbv-9999")
    e.chunks = chunks.drop("assertion_id")
    with pytest.raises(ValueError, match="assertion_id"):
        e.evidence(req)
