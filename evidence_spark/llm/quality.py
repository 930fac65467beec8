"""Quality rules: measures of whole texts held against thresholds that quantile sketches of each language and source give."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A text with fewer words fails, as does one with more than this share of repeated words, in percent.
LEAST_WORDS, REPEATED = 50, 50
#: Leading binary digits of a value that a sketch keeps; its quantiles are off by one part in 2 ** (DIGITS - 1) at most.
DIGITS = 6
#: Rows that a group's own sketch needs; smaller groups use their language's, then that of all rows.
LEAST_ROWS = 100
#: Distance of a fence from the quartile, in quartile distances.
REACH = 3


@dataclass(frozen=True)
class Rule:
    """A measure in thousandths, num / den. slack: the least distance of a fence from its quartile, so that a measure that is
    the same in most texts does not turn small differences into failures."""

    name: str
    num: str
    den: str
    slack: int
    lower: bool = False


RULES = (
    Rule("word_length", "word_chars", "n_words", 1000, lower=True),
    Rule("symbols", "n_symbols", "n_words", 100),
    Rule("dup_lines", "n_dup_lines", "n_lines", 500),
    Rule("repeats", "n_repeat_words", "n_words", 400),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measures(text: bytes) -> tuple[int, ...]:
    """MEASURES of a UTF-8 text. Words are parted by space and the controls 9 to 13, as bytes.split() does."""
    words = text.split()
    if not words:
        return (0,) * len(MEASURES)
    chars = len(text.translate(None, b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))))  # neither white space nor a byte that goes on
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), _repeats(words))


def _repeats(words: list[bytes]) -> int:
    """Words in windows of three that come twice or more."""
    import numpy as np

    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) < 1 << 21:
        key = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:]
    else:  # the product would pass 64 bits
        pair = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)[1]
        key = pair * len(number) + ids[2:]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(n[at] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[hit + k] = True
    return int(covered.sum())


def _measure(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = []
        for at in range(0, batch.num_rows, 500):
            rows += [measures(t) for t in batch.column(3).slice(at, 500).cast(pa.binary()).to_pylist()]
        cols = list(zip(*rows, strict=True)) or [[]] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "lang", "source", *MEASURES])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, *MEASURES), one row for each row of docs; null texts, languages and sources are empty ones."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(_measure, "doc_id long, lang string, source string, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * n)


def value(rule: Rule) -> Column:
    """The measure in whole thousandths; null where there is nothing to divide by."""
    return F.expr(f"CASE WHEN {rule.den} > 0 THEN 1000 * {rule.num} div {rule.den} END")


def bucket(v: Column) -> Column:
    """The lowest value of v's bucket: v without the binary digits after its first DIGITS."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - DIGITS)
    return F.when(v < 1 << DIGITS, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift))


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, rule, bucket, n): a quantile sketch of each measure for each group, as the counts of its buckets.

    A sketch holds at most 2 ** (DIGITS - 1) buckets for each binary digit of a value, whatever the number of rows. Sketches
    merge by adding counts: tasks make partial ones, and merge_sketches() makes those of larger groups out of smaller ones.
    """
    values = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), value(r).alias("v")) for r in RULES)))
    one = rows.select(*keys, values.alias("x")).where("x.v is not null")
    return one.groupBy(*keys, F.col("x.rule").alias("rule"), bucket(F.col("x.v")).alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, rule, rows, low, high): Tukey's fences from the sketch's quartiles; low is null for rules with an upper one alone."""
    w = Window.partitionBy(*keys, "rule")
    run = sketch.select(*keys, "rule", "bucket", F.sum("n").over(w).alias("rows"), F.sum("n").over(w.orderBy("bucket")).alias("up_to"))
    q = lambda k: F.min(F.when(4 * F.col("up_to") >= k * F.col("rows"), F.col("bucket")))
    t = run.groupBy(*keys, "rule").agg(F.max("rows").alias("rows"), q(1).alias("q1"), q(3).alias("q3"))
    slack, lower = F.lit(0), F.lit(False)
    for r in RULES:
        slack, lower = F.when(F.col("rule") == r.name, r.slack).otherwise(slack), F.when(F.col("rule") == r.name, r.lower).otherwise(lower)
    reach = F.greatest(REACH * (F.col("q3") - F.col("q1")), slack)
    return t.select(*keys, "rule", "rows", F.when(lower, F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, low, high): for each group, the fences of each rule by name as maps. They come from the group's own sketch
    if it counts LEAST_ROWS, else from its language's, else from that of all rows."""
    own = materialize(sketches(rows, ["lang", "source"]), "sketches")
    wide = materialize(merge_sketches(own, ["lang"]), "lang-sketches")
    level = lambda s, keys, k: fences(s, keys).select(*keys, "rule", F.struct("rows", "low", "high").alias(k))
    every = level(merge_sketches(wide, []), [], "c")
    t = level(own, ["lang", "source"], "a").join(level(wide, ["lang"], "b"), ["lang", "rule"]).join(F.broadcast(every), "rule")  # one row for each rule
    best = F.when(F.col("a.rows") >= LEAST_ROWS, F.col("a")).when(F.col("b.rows") >= LEAST_ROWS, F.col("b")).otherwise(F.col("c"))
    as_map = lambda c: F.map_from_entries(F.collect_list(F.struct("rule", F.col(f"best.{c}"))))
    return t.select("lang", "source", "rule", best.alias("best")).groupBy("lang", "source").agg(as_map("low").alias("low"), as_map("high").alias("high"))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, *MEASURES, base_failed, kept), one row for each row of docs.

    A text fails outright with under LEAST_WORDS words or with more than half of its words in repeated windows of three. All
    others are held against their group's fences: the length of words on both sides, signs, repeated lines and repeated words
    from above. Sketches count only texts that pass the first test, so that scraps do not set the standard.

    Null texts are empty and fail. Null languages and sources are groups of their own ('' counts as the same). Rows that repeat
    a doc_id are judged each for itself. A group of any size is one sketch: its rows are counted where they are read. The
    thresholds have a row for each group and are written first, so that Spark sends them out where they are small, and shuffles
    and splits otherwise. Other columns are not read; an empty table gives an empty result.
    """
    rows = materialize(measure(docs).withColumn("base_failed", base_failed()), "measures")
    limits = materialize(thresholds(rows.where("not base_failed")), "thresholds").withColumnsRenamed({"lang": "l", "source": "s"})
    inside = F.lit(True)
    for r in RULES:
        v, high, low = value(r), F.element_at("high", r.name), F.element_at("low", r.name)
        inside &= F.coalesce(v <= high, F.lit(True)) & F.coalesce(v >= low, F.lit(True))
    joined = rows.join(limits, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left")
    return joined.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & inside).alias("kept"))
