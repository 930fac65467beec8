"""Chunk generators. Token windows come in closed form, so no loop over windows is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as T

COLUMNS = ["chunk_id", "ref_id", "level", "chunk_type", "payload", "page", "section", "locator", "idx", "n_tokens"]


def _row(ref_id, level, kind, payload, page, section, locator, idx, n_tokens, chunk_id) -> list[Column]:
    values = dict(zip(COLUMNS, (chunk_id, ref_id, F.lit(level), F.lit(kind), payload, page, section, locator, idx.cast("long"), n_tokens.cast("long")), strict=True))
    return [values[c].alias(c) for c in COLUMNS]


def chunk_text(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Windows of tokens over docs (ref_id, text, page, section).

    The body of a window holds the tokens that the metadata prefix and one space leave; windows overlap. A prefix that fills
    the whole budget is an error. n tokens make one window if they fit, else ceil((n - body) / step) + 1.
    """
    prefix = T.metadata_prefix(F.col("ref_id"), F.col("page"), F.col("section"), "text")
    d = docs.select("ref_id", "page", "section", prefix.alias("prefix"), T.word_tokens(F.col("text")).alias("tokens"))
    body = F.lit(config.chunk_tokens) - F.size(T.word_tokens(F.col("prefix"))) - 1
    d = d.withColumn("body", F.when(body < 1, F.raise_error(F.lit("the metadata prefix leaves no room for text"))).otherwise(body))
    d = d.withColumn("step", F.col("body") - F.least(F.lit(config.chunk_overlap), F.col("body") - 1))
    n = F.size("tokens")
    count = F.when(n == 0, 0).when(n <= F.col("body"), 1).otherwise(F.ceil((n - F.col("body")) / F.col("step")) + 1).cast("int")
    d = d.withColumn("idx", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))))
    d = d.withColumn("window", F.slice("tokens", F.col("idx") * F.col("step") + 1, F.col("body"))).drop("tokens")
    text = F.array_join("window", "")
    kind = F.concat(F.lit("text:"), F.col("idx"))
    cid = T.chunk_id(F.col("ref_id"), F.col("page"), F.col("section"), kind, text)
    return d.select(*_row(F.col("ref_id"), "fine", "text", F.concat("prefix", F.lit(" "), text), F.col("page"), F.col("section"), F.coalesce("section", "page"), F.col("idx"), F.size("window"), cid))


def _single(docs: DataFrame, level: str, kind: str, payload: Column, locator: Column, ident: Column, prefixed: bool = True) -> DataFrame:
    text = F.concat(T.metadata_prefix(F.col("ref_id"), F.col("page"), F.col("section"), kind), F.lit(" "), payload) if prefixed else payload
    cid = T.chunk_id(F.col("ref_id"), F.col("page"), F.col("section"), ident, payload)
    return docs.select(*_row(F.col("ref_id"), level, kind, text, F.col("page"), F.col("section"), locator, F.lit(0), F.size(T.word_tokens(text)), cid))


def chunk_summary(docs: DataFrame) -> DataFrame:
    """One coarse chunk for each (ref_id, page, summary), its text as it is, without section and locator."""
    none = F.lit(None).cast("string")
    return _single(docs.select("ref_id", "page", none.alias("section"), "summary"), "coarse", "document_summary", F.col("summary"), none, F.lit("summary"), prefixed=False)


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat_ws("\n", *(F.when(F.length(c) > 0, F.concat(F.lit(f"{label}: "), c)) for label, c in pairs))


def chunk_table(tables: DataFrame) -> DataFrame:
    """One chunk for each table (ref_id, page, section, table_id, caption, headers, units, row_summary); never cut."""
    body = _lines(("Caption", F.col("caption")), ("Headers", F.array_join("headers", ", ")), ("Units", F.array_join("units", ", ")), ("Rows", F.col("row_summary")))
    ident = F.concat(F.lit("table:"), "table_id")
    return _single(tables, "fine", "table", F.when(body == "", F.concat(F.lit("Table "), "table_id")).otherwise(body), F.col("table_id"), ident)


def chunk_chart(charts: DataFrame) -> DataFrame:
    """One chunk for each chart (ref_id, page, section, chart_id, caption, axes, units, summary), all of them texts."""
    body = _lines(("Caption", F.col("caption")), ("Axes", F.col("axes")), ("Units", F.col("units")), ("Summary", F.col("summary")))
    ident = F.concat(F.lit("chart:"), "chart_id")
    return _single(charts, "fine", "chart", F.when(body == "", F.concat(F.lit("Chart "), "chart_id")).otherwise(body), F.col("chart_id"), ident)


def chunk_evidence_cards(assertions: DataFrame) -> DataFrame:
    """One chunk for each assertion; its locator serves as section. A range shows as [lo, hi]."""
    pair = F.concat(F.lit("["), T.float_text(F.col("value_lo")), F.lit(", "), T.float_text(F.col("value_hi")), F.lit("]"))
    value = F.coalesce(T.float_text(F.col("value_num")), pair, F.col("value_text"), F.lit("None"))
    conditions = F.array_join(F.transform("conditions", lambda c: F.concat(F.coalesce(c["eddo_class"], F.lit("")), F.lit("="), F.coalesce(c["value"], F.lit("None")), F.coalesce(c["unit"], F.lit("")))), "; ")
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("")))
    lines = F.concat_ws(
        "\n", line("Subject", F.col("entity")), line("Property", F.col("property")), F.rtrim(F.concat(F.lit("Value: "), value, F.lit(" "), F.coalesce("unit", F.lit("")))), F.when(F.size("conditions") > 0, F.concat(F.lit("Conditions: "), conditions)),
        line("Ref", F.col("ref_id")), F.concat(F.lit("Locator: "), F.coalesce(F.nullif("locator", F.lit("")), F.lit("-"))), line("Confidence", F.col("confidence")),
    )
    d = assertions.select("ref_id", F.lit(None).cast("string").alias("page"), F.col("locator").alias("section"), "id", "locator", lines.alias("card"))
    return _single(d, "fine", "evidence_card", F.col("card"), F.col("locator"), F.concat(F.lit("evidence:"), "id"))
