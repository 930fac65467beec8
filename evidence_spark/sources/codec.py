"""JSON to typed rows and back: requests are decoded with defaults and enum checks, or strictly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLAIM_TYPES, CONFIDENCE, ORIGINS, VALUE_TYPES

ASSERTION = (
    "id string, subject struct<eddo_class: string, resolved_entity: string, original_mention: string>, property string, object struct<value: string, unit: string, value_type: string, uncertainty: double>, "
    "conditions array<struct<eddo_class: string, value: string, unit: string>>, provenance struct<locator: string, sentence: string>, claim_type string, source_claim_origin string, confidence string, quality double, "
    "missing_unit boolean, speculative_wording boolean, chart_quality_low boolean, _bad string"
)
REQUEST = "query string, subqueries array<string>, top_k int, coarse_top_k int, allowed_ref_ids array<string>, coverage_keys array<string>, required_coverage_keys array<string>, private_data_unauthorized boolean, calibrated_support double, at_version_id string"
CLAIM = (
    "claim_id string, text string, anchor_chunk_ids array<string>, is_critical_numeric boolean, coverage_key string, numeric_source_ranges array<struct<lo: double, hi: double>>, "
    "cited struct<ref_id: string, cited_title: string, cited_doi: string>, private_data_unauthorized boolean, mechanism_supported boolean"
)
#: Field, default, allowed values.
CHECKED = (("object.value_type", "number", VALUE_TYPES), ("claim_type", "measurement", CLAIM_TYPES), ("source_claim_origin", "primary", ORIGINS), ("confidence", "medium", CONFIDENCE))
REQUIRED = ("id", "subject.original_mention", "property")


def decoded_assertions(rows: DataFrame, strict: bool = False) -> DataFrame:
    """What decode_assertions() splits, in one frame: the columns of rows, errors (empty for a decoded row) and decoded, a struct
    of the flat columns. Each text is parsed once: the parsed struct comes out of an explode, so that no filter or projection
    over its fields parses the text again."""
    d = rows.withColumn("a", F.explode(F.array(F.from_json("json", ASSERTION, {"columnNameOfCorruptRecord": "_bad"}))))
    errors = [F.when(F.col("a").isNull() | F.col("a._bad").isNotNull(), F.lit("not_json"))]
    errors += [F.when(F.coalesce(F.col(f"a.{c}"), F.lit("")) == "", F.lit(f"missing:{c}")) for c in REQUIRED]
    values = {}
    for field, default, allowed in CHECKED:
        got = F.col(f"a.{field}")
        values[field] = got if strict else F.coalesce(got, F.lit(default))
        errors.append(F.when(values[field].isNull() | ~values[field].isin(*allowed), F.lit(f"invalid:{field}")))
    number = F.expr("try_cast(a.object.value AS double)")
    pair = F.from_json("a.object.value", "array<double>")
    kind = values["object.value_type"]
    flat: dict[str, Column] = {
        "id": F.col("a.id"), "entity": F.coalesce("a.subject.resolved_entity", "a.subject.original_mention"), "property": F.col("a.property"), "value_type": kind, "value_num": F.when(kind == "number", number),
        "value_lo": F.when(kind == "range", F.get(pair, 0)), "value_hi": F.when(kind == "range", F.get(pair, 1)), "value_text": F.when(~kind.isin("number", "range"), F.col("a.object.value")), "unit": F.col("a.object.unit"),
        "uncertainty": F.col("a.object.uncertainty"), "conditions": F.coalesce("a.conditions", F.array().cast("array<struct<eddo_class: string, value: string, unit: string>>")), "locator": F.col("a.provenance.locator"),
        "claim_type": values["claim_type"], "source_claim_origin": values["source_claim_origin"], "confidence": values["confidence"], "quality": F.coalesce("a.quality", F.lit(0.5)), "missing_unit": F.coalesce("a.missing_unit", F.lit(False)), "speculative_wording": F.coalesce("a.speculative_wording", F.lit(False)),
    }
    return d.select(*rows.columns, F.array_compact(F.array(*errors)).alias("errors"), F.struct(*(c.alias(n) for n, c in flat.items())).alias("decoded"))


def decode_assertions(rows: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(decoded, refused) of rows with a column json; other columns are kept.

    Decoded rows are flat: id, entity, property, value_*, unit and so on. Missing enums take their default, unless strict;
    unknown ones, missing required fields and broken JSON refuse a row, with the reasons in errors.
    """
    d = decoded_assertions(rows, strict)
    keep = [c for c in rows.columns if c not in ("json", "id", "entity", "property")]
    flat = [n for n in d.schema["decoded"].dataType.names if n not in keep]
    return d.where("size(errors) = 0").select(*keep, *(f"decoded.{n}" for n in flat)), d.where("size(errors) > 0").select(*rows.columns, "errors")


def decode_requests(rows: DataFrame) -> DataFrame:
    """Evidence requests (request_id, json). Subqueries default to the query, coverage keys to sq1..n, empty lists of
    allowed references to none (unrestricted), empty required keys to all keys."""
    d = rows.select("request_id", F.from_json("json", REQUEST).alias("r"))
    filled = lambda c: F.when(F.size(c) > 0, c)
    subs = F.coalesce(filled(F.col("r.subqueries")), F.array("r.query"))
    d = d.withColumn("subqueries", subs)
    keys = F.coalesce(filled(F.col("r.coverage_keys")), F.transform("subqueries", lambda _, i: F.concat(F.lit("sq"), i + 1)))
    d = d.withColumn("coverage_keys", keys)
    return d.select(
        "request_id", F.col("r.query").alias("query"), "subqueries", "coverage_keys", F.coalesce(filled(F.col("r.required_coverage_keys")), F.col("coverage_keys")).alias("required_coverage_keys"), filled(F.col("r.allowed_ref_ids")).alias("allowed_ref_ids"),
        F.coalesce("r.top_k", F.lit(5)).alias("top_k"), F.coalesce("r.coarse_top_k", F.lit(10)).alias("coarse_top_k"), F.coalesce("r.private_data_unauthorized", F.lit(False)).alias("private_data_unauthorized"), F.col("r.calibrated_support").alias("calibrated_support"), F.col("r.at_version_id").alias("at_version_id"),
    )


def decode_claims(rows: DataFrame) -> DataFrame:
    """Claims (query_id, json) as guard.* takes them."""
    d = rows.select("query_id", F.from_json("json", CLAIM).alias("c"))
    no = F.lit(False)
    return d.select(
        "query_id", "c.claim_id", "c.text", F.coalesce("c.anchor_chunk_ids", F.array().cast("array<string>")).alias("anchor_chunk_ids"), "c.numeric_source_ranges", F.coalesce("c.is_critical_numeric", no).alias("is_critical_numeric"), "c.coverage_key",
        F.coalesce("c.private_data_unauthorized", no).alias("private_data_unauthorized"), "c.mechanism_supported", F.lit(1.0).alias("calibrated_support"), F.col("c.cited.ref_id").alias("cited_ref_id"), "c.cited.cited_doi", "c.cited.cited_title", F.lit(None).cast("string").alias("assertion_id"),
    )


def encode(rows: DataFrame, key: str, name: str = "json") -> DataFrame:
    """One JSON text for each row, nulls written out; the key stays beside it."""
    return rows.select(key, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(name))


def encode_bundles(records: DataFrame, covered: DataFrame) -> DataFrame:
    """bundle (query_id, json): hits in rank order without their excerpt, and coverage."""
    hits = records.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "ref_id", "locator", "confidence", "evidence_type", "guardable"))).alias("evidence_records"))
    keys = covered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("coverage_key", "hit_count", "guardable_count", "covered"))).alias("coverage"))
    return encode(hits.join(keys, "query_id", "full_outer"), "query_id")
