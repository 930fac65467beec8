"""The engine's inputs derived from the driver's tables. evidence_spark.plans.oracle derives the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """ref_id, doc_id, text, section, page, title, quality_grade."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    grade = F.when(F.col("toxic") == 1, "D").when(F.col("quality") == 1, "A").when(F.col("quality") == 0, "C").otherwise("B")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("DOC-"), "doc_id").alias("ref_id"), "doc_id", "text", F.col("source").alias("section"), F.col("lang").alias("page"), F.substring("text", 1, 60).alias("title"), grade.alias("quality_grade")
    )


def plain_documents(spark: SparkSession, d: str) -> DataFrame:
    """ref_id, doc_id, text, section, page: without the join to labels."""
    return table(spark, d, "documents").select(F.concat(F.lit("DOC-"), "doc_id").alias("ref_id"), "doc_id", "text", F.col("source").alias("section"), F.col("lang").alias("page"))


def chunks(spark: SparkSession, d: str, hits: DataFrame | None = None) -> DataFrame:
    """Fine text windows and one coarse summary for each document, or each that has a hit (ref_id): to fetch the payloads of hits
    no other document is cut into chunks again."""
    docs = plain_documents(spark, d)
    if hits is not None:
        docs = docs.join(hits.select("ref_id").distinct(), "ref_id", "left_semi")
    return chunking.chunk_text(docs).unionByName(chunking.chunk_summary(docs.withColumn("summary", summary(F.col("text")))))


def summary(text: Column) -> Column:
    """A document's summary: the distinct words of its whole text, in order of their bytes."""
    return F.array_join(F.array_sort(F.array_distinct(T.keyword_tokens(text))), " ")


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, ref_id, label, embedding."""
    return table(spark, d, "embeddings").select(F.concat(F.lit("V-"), "vec_id").alias("chunk_id"), F.concat(F.lit("DOC-"), "vec_id").alias("ref_id"), "label", "embedding")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector is a query."""
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", "embedding")


def curation_documents(spark: SparkSession, d: str) -> DataFrame:
    """One document for each supplier, with metadata that is missing here and there."""
    k = F.col("s_suppkey")
    grade = F.when(k % 10 == 0, "C").when(k % 10 == 1, "D").when(k % 2 == 0, "A").otherwise("B")
    chart = F.struct(
        F.concat(F.lit("CH-"), k).alias("id"), (k % 7 != 0).alias("caption_complete"), F.lit(True).alias("axes_complete"), F.lit(True).alias("units_complete"), (k % 17 == 0).alias("not_digitizable"), F.lit(False).alias("quality_low")
    )
    return table(spark, d, "supplier").select(
        F.concat(F.lit("S"), k).alias("ref_id"),
        F.struct(
            F.col("s_name").alias("title"),
            F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array("s_name")).alias("authors"),
            (F.lit(1990) + F.col("s_nationkey")).cast("int").alias("year"),
            F.lit("journal").alias("source"),
            F.when(F.col("s_acctbal") > 0, F.concat(F.lit("10.1000/s."), k)).alias("doi"),
            F.when(k % 3 == 0, F.concat(F.lit("ST-"), k)).alias("stable_id"),
        ).alias("metadata"),
        grade.alias("quality_grade"),
        (k % 13 == 0).alias("no_structured_data"),
        F.when(k % 2 == 0, F.col("s_nationkey").cast("int")).alias("schema_valid_count"),
        F.when(k % 2 == 0, F.lit(25)).alias("schema_total_count"),
        F.array(chart).alias("charts"),
    )


def assertions(spark: SparkSession, d: str) -> DataFrame:
    """One assertion for each line item about its part. Those of suppliers that 19 divides count as the supplier's before, so
    that some documents have none."""
    li = table(spark, d, "lineitem")
    supplier = F.col("l_suppkey") - F.when(F.col("l_suppkey") % 19 == 0, 1).otherwise(0)
    confidence = F.element_at(F.array(*map(F.lit, ("hypothesis", "medium", "high", "verified"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    relation = F.col("l_linenumber") == 7
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.concat(F.lit("S"), supplier).alias("ref_id"),
        F.concat(F.lit("P"), "l_partkey").alias("entity"),
        F.col("l_returnflag").alias("property"),
        F.when(relation, "enum").otherwise("number").alias("value_type"),
        F.when(~relation, F.col("l_extendedprice") / F.col("l_quantity")).alias("value_num"),
        F.lit(None).cast("double").alias("value_lo"),
        F.lit(None).cast("double").alias("value_hi"),
        F.when(relation, F.when(F.col("l_quantity") > 25, "high").otherwise("low")).alias("value_text"),
        F.col("l_tax").alias("uncertainty"),
        F.when(F.col("l_discount") != 0, F.lit("USD")).alias("unit"),
        F.array(F.struct(F.lit("LineStatus").alias("eddo_class"), F.col("l_linestatus").alias("value"), F.lit(None).cast("string").alias("unit"))).alias("conditions"),
        F.when(F.col("l_tax") != 0, F.concat(F.lit("T"), "l_linenumber")).alias("locator"),
        F.when(relation, "relation").otherwise("measurement").alias("claim_type"),
        F.when(F.col("l_linestatus") == "F", "primary").otherwise("secondary").alias("source_claim_origin"),
        confidence.alias("confidence"),
        F.lit(False).alias("missing_unit"),
        (F.col("l_quantity") > 45).alias("speculative_wording"),
        (F.col("l_shipdate") >= "1998-01-01").alias("is_new"),
    )


def new_and_existing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = assertions(spark, d)
    return a.where("is_new").drop("is_new"), a.where("not is_new").drop("is_new")


def versions(spark: SparkSession, d: str) -> DataFrame:
    """version_id, prior_version_id: a chain with one version for each day of events."""
    days = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    return days.select(F.concat(F.lit("kbv-"), F.date_format("day", "yyyyMMdd")).alias("version_id"), F.concat(F.lit("kbv-"), F.date_format(F.date_sub("day", 1), "yyyyMMdd")).alias("prior")).alias("a").join(
        days.select(F.concat(F.lit("kbv-"), F.date_format("day", "yyyyMMdd")).alias("v")).alias("b"), F.col("prior") == F.col("v"), "left"
    ).select("version_id", F.col("v").alias("prior_version_id"))


def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Document lifecycle records from events; each is bound to the version of its day, purchases of odd users are not bound."""
    status = F.when(F.col("event_type") == "error", "retracted").when(F.col("event_type") == "view", "archived").when(F.col("event_type") == "purchase", "superseded").otherwise("active")
    bound = F.when(~((F.col("event_type") == "purchase") & (F.col("user_id") % 2 == 1)), F.concat(F.lit("kbv-"), F.date_format("ts", "yyyyMMdd")))
    return table(spark, d, "events").select(
        F.concat(F.lit("LC-"), "event_id").alias("lifecycle_id"), F.concat(F.lit("DOC-"), "user_id").alias("ref_id"), status.alias("status"), F.col("event_type").alias("reason"), bound.alias("effective_version_id"), F.col("event_id").alias("created_seq")
    )


def version_trees(spark: SparkSession, d: str) -> DataFrame:
    """version_id, prior_version_id, event_type, created_seq: each event is a version of its user's document. It follows on the
    event before, but after an error on the one before that, as if the error had been rolled back."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    before = F.when(F.lag("event_type").over(w) == "error", F.lag("event_id", 2).over(w)).otherwise(F.lag("event_id").over(w))
    return table(spark, d, "events").select(F.concat(F.lit("E"), "event_id").alias("version_id"), F.concat(F.lit("E"), before).alias("prior_version_id"), "event_type", F.col("event_id").alias("created_seq"))


def history(spark: SparkSession, d: str) -> DataFrame:
    """Sources registered before, one for each document: each states a DOI, a stable id or a title alone."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        k.alias("seq"), F.concat(F.lit("REF-"), k).alias("ref_id"), F.sha2("text", 256).alias("source_fingerprint"), F.when(k % 3 == 2, F.col("text")).alias("title"),
        F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/"), F.col("n_chars") % 400)).alias("doi"), F.when(k % 3 == 1, F.concat(F.lit(" ST-"), F.col("n_chars") % 300)).alias("stable_id"), F.when(k % 2 == 0, "preprint").otherwise("journal").alias("source_kind"),
    )


def submissions(spark: SparkSession, d: str) -> DataFrame:
    """Source candidates, one for each document: replays, contradictions, known and new identifiers, titles alone."""
    k, m = F.col("doc_id"), F.col("doc_id") % 8
    known_doi, known_sid = F.concat(F.lit("DOI:10.1000/"), F.col("n_chars") % 400), F.concat(F.lit("ST-"), F.col("n_chars") % 300)
    own_doi, own_sid = F.when(k % 3 == 0, known_doi), F.when(k % 3 == 1, known_sid)
    return table(spark, d, "documents").select(
        k.alias("seq"), F.concat(F.when(m <= 2, "REF-").otherwise("NEW-"), k).alias("ref_id"), F.sha2("text", 256).alias("source_fingerprint"),
        F.when(m == 5, F.concat(F.lit("  "), "text", F.lit("\n"))).when(m == 2, F.lit("Another title")).when((m == 0) & (k % 3 == 2), F.col("text")).alias("title"),
        F.when(m == 0, own_doi).when(m == 1, F.concat(F.lit("10.9/"), k)).when(m.isin(3, 6), known_doi).when(m == 7, F.concat(F.lit("10.9/"), k)).alias("doi"),
        F.when(m == 0, own_sid).when(m.isin(4, 6), known_sid).alias("stable_id"), F.when(k % 2 == 0, "preprint").otherwise("journal").alias("source_kind"),
    )


def batch(spark: SparkSession, d: str) -> DataFrame:
    """The history and the submissions as one batch, those of a document one after the other: nothing is known before it."""
    return history(spark, d).withColumn("seq", F.col("seq") * 2).unionByName(submissions(spark, d).withColumn("seq", F.col("seq") * 2 + 1))


def lineage_submissions(spark: SparkSession, d: str) -> DataFrame:
    """Source candidates that state a lineage, one for each document: works and versions known and unknown, each relation."""
    k = F.col("doc_id")
    relation = F.element_at(F.array(F.lit(None), *map(F.lit, ("none", "revision_of", "preprint_to_journal", "corrected_version", "explicit_same_work"))), (k % 6 + 1).cast("int"))
    return table(spark, d, "documents").select(
        k.alias("seq"), F.concat(F.when(k % 11 == 0, "REF-").otherwise("NEW-"), k).alias("ref_id"), F.sha2("text", 256).alias("source_fingerprint"), F.lit(None).cast("string").alias("title"),
        F.when(k % 7 == 0, F.concat(F.lit("10.1000/"), F.col("n_chars") % 400)).alias("doi"), F.when(k % 7 == 1, F.concat(F.lit("ST-"), F.col("n_chars") % 300)).alias("stable_id"), F.when(k % 2 == 0, "preprint").otherwise("journal").alias("source_kind"),
        F.when(k % 5 == 0, F.concat(F.lit("W-"), k)).when(k % 5 == 1, F.concat(F.lit("W-"), k + 1)).when(k % 25 == 2, F.lit("W-none")).alias("explicit_work_id"),
        F.when(k % 10 < 4, F.concat(F.lit("SV-"), k)).when(k % 10 == 4, F.concat(F.lit("SV-"), k + 1)).when(k % 50 == 5, F.lit("SV-none")).alias("explicit_prior_version_id"), relation.alias("explicit_relation"),
    )


def _unit_key():
    return F.col("conv_id") * 10 + F.col("turn")


def units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(prior, new) content units: each conversation and a revision of it, with turns dropped, changed, renamed and added."""
    c, k = table(spark, d, "conversations"), _unit_key()
    content = lambda text: F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), text), 256)
    text, unit, none = F.coalesce("text", F.lit("")), F.concat(F.lit("U"), "turn"), F.lit(None).cast("string")
    prior = c.select(F.col("conv_id").alias("pair_id"), unit.alias("unit_id"), content(text).alias("content_hash"), none.alias("prior_unit_id"), F.concat(F.lit("L"), "turn").alias("locator"))
    renamed = k % 5 == 1
    claim = F.when(renamed, F.when(F.col("conv_id") % 13 == 5, F.lit("U99")).when(F.col("conv_id") % 17 == 3, F.lit("U0")).otherwise(unit))
    kept = c.where(k % 7 != 3).select(F.col("conv_id").alias("pair_id"), F.when(renamed, F.concat(F.lit("N"), "turn")).otherwise(unit).alias("unit_id"), content(F.when(k % 3 == 0, F.concat(text, F.lit(" (rev)"))).otherwise(text)).alias("content_hash"), claim.alias("prior_unit_id"), F.concat(F.lit("L"), "turn").alias("locator"))
    added = c.where(k % 11 == 0).select(F.col("conv_id").alias("pair_id"), F.concat(F.lit("X"), "turn").alias("unit_id"), content(F.reverse(text)).alias("content_hash"), none.alias("prior_unit_id"), F.concat(F.lit("X"), "turn").alias("locator"))
    return prior, kept.unionByName(added)


def resets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("conv_id % 23 = 6").select(F.col("conv_id").alias("pair_id")).distinct()


def unit_assertions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(prior, new) assertions of the units, two for each: slots are roles and notes, the payload is the text."""
    c, k = table(spark, d, "conversations"), _unit_key()
    two = lambda side, second: F.explode(F.array(F.struct(F.lit(1).alias("n"), F.coalesce("role", F.lit("")).alias("slot")), F.struct(F.lit(2).alias("n"), second.alias("slot"))))
    cols = lambda unit, side: [F.col("conv_id").alias("pair_id"), unit.alias("unit_id"), F.concat(F.lit(side), "conv_id", F.lit("."), "turn", F.lit("."), "x.n").alias("assertion_id"), F.col("x.slot").alias("slot_key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("payload_hash")]
    unit = F.concat(F.lit("U"), "turn")
    prior = c.withColumn("x", two("A", F.when(k % 4 == 0, F.coalesce("role", F.lit(""))).otherwise(F.lit("note"))))
    prior = prior.select(*cols(F.when((F.col("conv_id") % 19 == 4) & (F.col("turn") == 1), F.lit("U77")).otherwise(unit), "A"))
    note = F.when(k % 8 == 2, F.lit("other")).otherwise(F.lit("note"))
    kept = c.where(k % 7 != 3).withColumn("x", two("B", note)).select(*cols(F.when(k % 5 == 1, F.concat(F.lit("N"), "turn")).otherwise(unit), "B"))
    added = c.where(k % 11 == 0).withColumn("x", two("X", note)).select(*cols(F.concat(F.lit("X"), "turn"), "X"))
    return prior, kept.unionByName(added)


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Evidence requests from the benchmark: whole texts, texts in two parts, and parts that nothing can answer."""
    k = F.col("item_id")
    subs = F.when(k % 3 == 1, F.array(F.substring("text", 1, 100), F.substr(F.col("text"), F.lit(101)))).when(k % 3 == 2, F.array(F.col("text"), F.lit("zzqx qqzx")))
    refs = F.when(k % 6 == 5, F.transform(F.sequence(k * 5, k * 5 + 200), lambda x: F.concat(F.lit("DOC-"), x)))
    return table(spark, d, "benchmark").select(
        k.alias("request_id"), F.col("text").alias("query"), subs.alias("subqueries"), F.lit(None).cast("array<string>").alias("coverage_keys"), F.when(k % 4 == 1, F.array(F.lit("sq1"))).alias("required_coverage_keys"),
        refs.alias("allowed_ref_ids"), (k % 7 == 3).alias("private_data_unauthorized"), F.when(k % 5 == 2, 0.1).when(k % 5 == 3, 0.9).alias("calibrated_support"),
    )


#: Phrases that the fixture's task texts end with.
PHRASES = ("please publish the journal version", "curate and commit these assertions", "search the evidence", "nothing in particular", "find a preprint", "ingest, then look it up: lookup", "撤稿", "策审 入库 检索")


def task_texts(spark: SparkSession, d: str) -> DataFrame:
    """task_id, text: each benchmark text and a phrase."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("item_id") % len(PHRASES) + 1).cast("int"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), F.concat("text", F.lit(" "), phrase).alias("text"))


def publications(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(packages, registry, target, request, decisions): a revision for each customer, its assertions the customer's orders.
    Here and there something is missing or differs."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    name = lambda p: F.concat(F.lit(p), k)
    at = lambda n, odd, plain: F.when(k % n == 0, odd).otherwise(plain)
    c = table(spark, d, "customer")
    packages = c.select(
        name("P-").alias("package_id"), at(41, F.lit("PV-none"), name("PV-")).alias("prior_id"), name("NV-").alias("new_id"), name("R").alias("prior_ref"), at(19, F.lit("N0"), name("N")).alias("new_ref"),
        at(23, F.lit("corrected_version"), F.lit("revision_of")).alias("relation"), at(29, F.lit("W0"), name("W")).alias("work_id"), at(31, F.lit("kbv-2"), F.lit("kbv-1")).alias("prior_bound_version"), (k % 17 == 0).alias("requires_manual_review"),
        at(37, none, name("N")).alias("source_ref"), at(13, F.lit("fp9"), F.lit("fp2")).alias("source_fingerprint"), name("N").alias("set_ref"), at(43, F.lit("Z"), name("N")).alias("report_ref"), at(7, F.lit("rejected"), F.lit("successful")).alias("report_status"),
        (k % 47 == 0).cast("long").alias("returned_upstream"), at(53, F.lit("other"), F.lower("c_name")).alias("title"), at(5, none, at(11, F.lit("rejected"), F.lit("approved"))).alias("approval_decision"), at(59, F.lit("P-0"), name("P-")).alias("approval_package"),
        name("AP").alias("approval_id"), at(61, F.lit(""), F.lit("someone")).alias("approver"), F.when(k % 10 == 3, F.lit("other")).otherwise(F.concat_ws("/", name("P-"), name("N"), F.lit("fp2"))).alias("approval_scope"), at(73, F.lit(False), F.lit(True)).alias("requires_approval"),
    )
    prior = c.select(name("PV-").alias("source_version_id"), name("W").alias("work_id"), name("R").alias("ref_id"), F.lit("none").alias("relation"), none.alias("prior_source_version_id"), F.lit("fp1").alias("source_fingerprint"), F.lit("kbv-1").alias("kb_version_id"), at(67, none, name("s")).alias("snapshot_id"), F.lower("c_name").alias("norm_title"))
    new = c.select(name("NV-").alias("source_version_id"), name("W").alias("work_id"), name("N").alias("ref_id"), F.lit("revision_of").alias("relation"), at(71, F.lit("PV-0"), name("PV-")).alias("prior_source_version_id"), F.lit("fp2").alias("source_fingerprint"), none.alias("kb_version_id"), none.alias("snapshot_id"), F.lower("c_name").alias("norm_title"))
    registry = prior.unionByName(new).withColumn("norm_doi", none).withColumn("norm_stable", none)
    o = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(o, F.concat(F.lit("P-"), "o_custkey").alias("package_id"), F.concat(F.lit("A"), o).alias("id"), F.col("o_orderpriority").alias("material"))
    target = orders.select("package_id", "id", "material")
    request = orders.where(o % 97 != 0).select("package_id", "id", F.when(o % 89 == 0, F.lit("changed")).otherwise(F.col("material")).alias("material"))
    times = F.when(o % 61 == 0, 0).when(o % 67 == 0, 2).otherwise(1)
    decisions = orders.withColumn("t", F.explode(F.array_repeat(F.lit(1), times))).select("package_id", F.when(o % 79 == 0, F.concat(F.lit("Z"), o)).otherwise(F.col("id")).alias("assertion_id"), F.when(o % 83 == 0, "pending_review").when(o % 3 == 0, "downgrade").otherwise("accept").alias("action"))
    return packages, registry, target, request, decisions
