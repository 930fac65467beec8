"""Small cases of what the review of round 3 found."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidence_spark.functions import text as T
from evidence_spark.llm import common, queries, token_counts, token_store
from evidence_spark.llm.shingles import mix
from evidence_spark.operators import bm25, identity, lifecycle, vector, versions
from evidence_spark.plans.catalogue import QUERIES
from evidence_spark.sources import codec
from evidence_spark.tables import local


def test_visibility_of_unknown_documents(spark):
    """of a document that is not listed nothing is known, unless the assertion's own state hides it."""
    rows = spark.createDataFrame([("a", "known"), ("b", "lost"), ("c", "lost"), ("d", "hidden")], "id string, ref_id string")
    docs = spark.createDataFrame([("known", "active", True), ("hidden", "retracted", False)], "ref_id string, status string, visible boolean")
    own = spark.createDataFrame([("c", "archived")], "assertion_id string, status string")
    got = {r.id: (r.status, r.visible) for r in lifecycle.assertion_eligibility(rows, docs, own).collect()}
    assert got == {"a": ("active", True), "b": ("active", None), "c": ("archived", False), "d": ("retracted", False)}


@pytest.fixture(scope="module")
def two_items(spark, tmp_path_factory):
    """A supplier's line item, and two of one id whose supplier is not there."""
    d = str(tmp_path_factory.mktemp("two"))
    item = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
    lost = (1, 1, 0, 1, 10.0, 1000.0, 0.1, 0.1, "A", "F", "1999-01-01")
    old = (2, 1, 5, 1, 10.0, 1000.0, 0.1, 0.1, "A", "F", "1990-01-01")
    rows = spark.createDataFrame([lost, lost, (3, 1, 1, 1, 10.0, 100000.0, 0.1, 0.1, "A", "F", "1999-01-01"), old], item)
    rows.withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(1, "one", 3, 1.0), (5, "five", 3, 1.0)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    return d


def test_request_without_curated_document(spark, two_items):
    """assertions of documents that are not curated are not part of the request; supplier 1 is not formal and rejected."""
    assert [tuple(r) for r in QUERIES["request_validation"](spark, two_items).select("id", "error").collect()] == [("3-1-1-1", "missing_decision")]


def test_counts_of_a_shared_id(spark, two_items):
    """An id of two line items has one row, each item with the pairs of both."""
    got = {r.id: r.n_consistent for r in QUERIES["conflict_counts"](spark, two_items).collect()}
    assert got["1-1-1-0"] == 4 and len(got) == 2


def test_decoding_parses_once(spark):
    """neither the split nor the fields parse a text again."""
    rows = spark.createDataFrame([("S1", '{"id": "a", "subject": {"original_mention": "P"}, "property": "A"}'), ("S1", "{")], "ref_id string, json string")
    for part in codec.decode_assertions(rows):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("columnNameOfCorruptRecord") == 1
        assert part.count() == 1
    assert [(r.errors, r.decoded.id) for r in codec.decoded_assertions(rows).collect()][0] == ([], "a")


def test_small_tables_start_no_python(spark):
    """F8, F13: rows that the code states are literals, not a Python RDD."""
    two = local(spark, [("a", None), ("b", 2)], "k string, n long")
    assert sorted(map(tuple, two.collect())) == [("a", None), ("b", 2)] and local(spark, [], two.schema).count() == 0
    assert "RDD" not in two._jdf.queryExecution().optimizedPlan().toString()


def test_terms_in_one_pass(spark):
    """the chunks are tokenized once."""
    stats = bm25.term_stats(spark.createDataFrame([("a a b",), ("a",)], "payload string"))
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {r.term: (r.df, r.cf) for r in stats.collect()} == {"a": (2, 3), "b": (1, 1)}


def test_titles_fold_in_small_pieces(spark):
    """a batch is folded some texts at a time."""
    texts = [None, "", " \t\x1c ", "A\x0b\x1fB  c\x00", "x\u00a0Stra\u00dfe " * 400, "\u2007", *(f"\u00c9tude  {i} \ufb01n" * 300 for i in range(1000))]
    want = [t if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold() or None for t in texts]
    pieces = list(T.work_title.func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert [t for p in pieces for t in p.to_pylist()] == want and max(p.nbytes for p in pieces) < 2 * T.FOLDED < sum(p.nbytes for p in pieces)
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    assert [r[0] for r in rows.orderBy("i").select(T.work_title(F.col("t"))).collect()] == want


@pytest.mark.parametrize("most", [0, 4, 100_000])
def test_trees_walked_in_tasks_or_by_rounds(spark, monkeypatch, most):
    """small trees are walked whole, without rounds; either way the positions are the same."""
    rng = random.Random(7)
    prior = {f"v{i}": f"v{rng.randrange(max(0, i - 4), i)}" if i % 9 else None for i in range(60)}
    rows = spark.createDataFrame([*prior.items(), ("v5", prior["v5"]), ("w", "gone")], "version_id string, prior_version_id string").repartition(3)
    steps, real = [], versions.written
    monkeypatch.setattr(versions, "LOCAL", most)
    monkeypatch.setattr(versions, "written", lambda df, label: steps.append(label) or real(df, label))
    got = {r.version_id: (r.tree, r.depth, r.first, r.last) for r in versions.labels(rows).collect()}
    assert ("walk" in steps) == (most < 100)
    children = {v: sorted(c for c in prior if prior[c] == v) for v in prior} | {"gone": ["w"], "w": []}
    want = {}

    def walk(v, tree, depth, at):
        enter = at
        for c in children[v]:
            at = walk(c, tree, depth + 1, at + 1)
        want[v] = [tree, depth, enter, at + 1]
        return at + 1

    for root in [*(v for v in prior if not prior[v]), "gone"]:
        end = walk(root, root, 0, 0)
        for x in want.values():
            if x[0] == root:
                x[2:] = x[2] - end, x[3] - end
    assert got == {v: tuple(x) for v, x in want.items()}


def test_positions_meet_stretches_once(spark):
    """whatever a stretch's edges, each position in it is met once, and none beside it."""
    places = spark.range(1000).select(F.concat(F.lit("v"), "id").alias("version_id"), F.lit("t").alias("tree"), (F.col("id") - 999).alias("first"))
    ends = [(a, b) for a in (-2000, -999, -998, -777, -513, -512, -17, -16, -15, -1, 0) for b in (-999, -784, -768, -500, -256, -16, -15, -1, 0, 1, 40) if a < b]
    cuts = spark.createDataFrame([("t", i, a, b, "l", "active", None, 1) for i, (a, b) in enumerate(ends)], "tree string, ref_id long, begin long, end long, lifecycle_id string, status string, reason string, created_seq long")
    found = versions.states_at(cuts, places)
    got = sorted((r.ref_id, int(r.version_id[1:]) - 999) for r in found.collect())
    assert got == sorted((i, x) for i, (a, b) in enumerate(ends) for x in range(max(a, -999), min(b, 1)))


def test_rows_without_keys_are_spread(spark, monkeypatch):
    """rows that state nothing are not all dealt to one task, and no title travels whole; the registry has the titles."""
    rows = spark.range(400).select(F.col("id").alias("seq"), F.concat(F.lit("R"), "id").alias("ref_id"), F.lit("f").alias("source_fingerprint"), F.when(F.col("id") % 2 == 0, F.concat(F.repeat(F.lit("long "), F.lit(50)), F.col("id") % 100)).alias("title"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("stable_id"), F.lit("journal").alias("source_kind"))
    ready = identity.normalized(rows, T.ascii_work_title(F.col("title")))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        known = identity.register(ready.where("seq >= 390")).localCheckpoint()
        sizes = identity.classify_intake(ready, known).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 4 and max(r["count"] for r in sizes) < 200
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    lengths, real = [], identity.written
    monkeypatch.setattr(identity, "written", lambda df, label: lengths.extend(df.agg(F.max(F.length("norm_title"))).first() if "norm_title" in df.columns else []) or real(df, label))
    decisions, registry = identity.intake_in_order(ready, identity.register(ready.limit(0)))
    assert {r.disposition: r["count"] for r in decisions.groupBy("disposition").count().collect()} == {"new_work": 250, "review_required": 150}
    assert max(x for x in lengths if x) == 64
    titles = {r.ref_id: r.norm_title for r in registry.collect()}
    assert titles == {f"R{i}": "long " * 50 + str(i % 100) if i % 2 == 0 else None for i in range(400) if i % 2 or i < 100}


def test_searches_hold_small_blocks():
    """what a task holds besides a batch of 10,000 rows stays small, and the best are those of all rows."""
    import tracemalloc

    import numpy as np

    def peak(run, batch):
        tracemalloc.start()
        try:
            return list(run(iter([batch]))), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    r = np.random.default_rng(3)
    x, q = r.normal(size=(10_000, 8)), r.normal(size=(200, 8))
    names = pa.array([f"c{i:05}" for i in range(len(x))])
    found, most = peak(vector._search(pa.array(range(200)), q, None, 3), pa.RecordBatch.from_arrays([names, names, pa.array(x.tolist())], names=["chunk_id", "ref_id", "embedding"]))
    assert most < 28 << 20
    got = {}
    for b in found:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got.setdefault(k, set()).add(int(c[1:]))
    assert got == {k: set(np.argsort(-s)[:3].tolist()) for k, s in enumerate(q @ x.T)}
    words = pa.array([[f"w{(i * j) % 50}" for j in range(300)] for i in range(2000)])
    found, most = peak(bm25._counter(["w0", "w7"]), pa.RecordBatch.from_arrays([names[:2000], names[:2000], names[:2000], words], names=["chunk_id", "ref_id", "level", "t"]))
    assert most < 8 << 20 and sum(b.num_rows for b in found) == 2000


class Counted(dict):
    """The vocabulary, counting how often it is asked."""

    asked = 0

    def __contains__(self, piece):
        self.asked += 1
        return super().__contains__(piece)


def test_prefixes_try_only_pieces_that_end_there():
    """op3_token_counts: a chunk whose pairs are known is counted sign by sign, without a look-up for each start of a piece."""
    coder, chunk = token_counts.PieceBpe(queries.tokenizer("piece_bpe_32k.model")), "▁" + "thonre" * 50
    first = coder.prefixes(chunk)
    coder.score = Counted(coder.score)
    assert coder.prefixes(chunk) == first and coder.score.asked <= len(chunk)


@pytest.mark.parametrize("room", [100, 10**6])
def test_token_counts_with_full_tables(monkeypatch, room):
    """op3_token_counts: what a worker remembers, or drops, changes no count; the tables keep to their room."""
    import sentencepiece

    path, rng = queries.tokenizer("piece_bpe_32k.model"), random.Random(room)
    for name in ("CACHE", "CHUNKS", "ENDS"):
        monkeypatch.setattr(token_counts, name, room)
    coder, sp = token_counts.PieceBpe(path), sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p.replace("▁", " ") for p in coder.score]
    texts = ["".join(rng.choice(pieces) if rng.random() < 0.9 else chr(rng.choice([0, 10, 233, 8203, 27721, 57344, 128578])) for _ in range(rng.randrange(40))) for _ in range(60)]
    for text in texts:
        assert coder.count(text) == coder.counts(text)[-1] == len(sp.encode(text))
        assert len(coder.ends) <= room and sum(map(len, coder.apart.values())) == coder.n_pairs <= room and len(coder.totals) <= room + 1
    coder.forget()
    assert not (coder.n_pairs or any(coder.apart.values()) or coder.ends or coder.totals or coder.chunks)


def test_words_are_looked_up_once_in_many_texts(monkeypatch):
    """F1 of the last list, op9_token_store: a word costs a look-up for each batch, not for each place where it stands; ids stay the library's."""

    class Counted(common._Parts):
        asked = 0

        def __getitem__(self, part):
            Counted.asked += 1
            return super().__getitem__(part)

    coder = common.WordBpe(queries.tokenizer("word_bpe_49k.json"))
    coder.parts = Counted(coder.tokenizer.model.tokenize, "I")
    texts = ["The fox, the ÉCOLE's 12 foxes.\n", None, "", " \t\x0b\r\n", "  fox", "fox \f", "漢字 fox", "the <|endoftext|>"] * 300
    want = [list(e.ids) for e in coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [list(memoryview(x).cast("I")) if x else [] for x in coder.encode(texts)] == want
    assert Counted.asked <= 12
    monkeypatch.setattr(common, "SIGNS", 40)  # a few texts at a time
    assert [list(memoryview(x).cast("I")) if x else [] for x in coder.encode(texts)] == want
    assert coder.encode([]) == [] and coder.encode([" "]) == [b""]


def test_chunks_end_where_the_rolling_hash_says():
    """F1 of the last list, op9_token_store: ids of 16 bits take their hashes from a table; the ends are those of the formula."""
    rng = np.random.default_rng(3)
    for top in (1 << 16, 1 << 20):
        ids = rng.integers(0, top, 9000).astype("<u4")
        ids[0] = top - 1
        hashes, ends, last = [int(x) for x in mix(ids.astype(np.uint64) + np.uint64(1))], [], 0
        for at in range(token_store.ROLL, len(ids)):
            window = sum(h * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, h in enumerate(hashes[at - token_store.ROLL : at])) % (1 << 64)
            marked = int(mix(np.array([window], np.uint64))[0]) % token_store.MEAN == 0
            if at - last == token_store.MOST or marked and at - last >= token_store.LEAST:
                ends.append(at)
                last = at
        assert token_store.cuts(ids) == [*ends, len(ids)]
