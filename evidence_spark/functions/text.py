"""Column expressions over text: tokens, identifiers, metadata prefixes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

#: Labels of chunk kinds inside a metadata prefix; another kind is its own label.
KIND_LABELS = {"text": "文本", "table": "表", "chart": "图", "evidence_card": "证据卡"}


def word_tokens(text: Column) -> Column:
    """Runs of white space and of anything else, in order; joining them gives the text again."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\s+|\S+)"), 1)


def decode_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def mixed_tokens(text: Column) -> Column:
    """For corpora that mix scripts: runs of Latin letters and digits, each Han, kana or Hangul sign, each other sign that is
    no white space; case stays. A stand-in for a dictionary's segmentation, which needs a dictionary."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+(?:\.[0-9]+)?%?|\p{IsHan}|\p{IsHiragana}|\p{IsKatakana}|\p{IsHangul}|[^\sA-Za-z0-9])"), 1)


@pandas_udf(StringType())
def _shortest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for xs in batches:
        yield pd.Series(map(repr, xs.tolist()), dtype=object)


def float_text(x: Column) -> Column:
    """A double as the shortest decimal text that reads back as it: positional from 1e-4 up to 1e16, else with an exponent of two
    digits at least; nan and inf by name. In Python, as the digits of Java's own text depend on the JVM's version (before JDK 19
    some doubles get more than they need)."""
    return F.when(x.isNotNull(), _shortest(x.cast("double")))


def keyword_tokens(text: Column) -> Column:
    """Lower-cased words between white space, without blanks."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def _dash(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))


def metadata_prefix(ref_id: Column, page: Column, section: Column, kind: str) -> Column:
    return F.concat(F.lit("["), ref_id, F.lit("|"), _dash(page), F.lit("|"), _dash(section), F.lit(f"|type({KIND_LABELS.get(kind, kind)})]"))


def chunk_id(ref_id: Column, page: Column, section: Column, kind: Column, body: Column) -> Column:
    """The same document position and content give the same id."""
    parts = [F.coalesce(ref_id, F.lit("")), _dash(page), _dash(section), kind, F.substring(F.sha2(body, 256), 1, 16)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def work_doi(doi: Column) -> Column:
    """For identity: without doi: and resolver prefixes, trimmed, lower case; blank is null."""
    bare = F.regexp_replace(F.trim(doi), r"(?i)^doi:\s*", "")
    bare = F.regexp_replace(F.trim(bare), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.nullif(F.lower(F.trim(bare)), F.lit(""))


def cited_doi(doi: Column) -> Column:
    """For citations: lower case first, then only the plain resolver prefix goes; doi: stays, so the two differ on purpose."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(doi)), r"^https?://doi\.org/", "")), F.lit(""))


def cited_title(title: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(title), r"(?U)\s+", " ")), F.lit(""))


def stable_id(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def entity_id(eddo_class: Column, mention: Column) -> Column:
    name = F.replace(F.lower(F.trim(mention)), F.lit(" "), F.lit("_"))
    return F.when(name != "", F.concat(F.lit("eddo:"), F.lower(eddo_class), F.lit(":"), name))


#: Bytes of text that a worker folds at a time; a longer text is folded alone.
FOLDED = 1 << 20


@arrow_udf(StringType())
def work_title(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """For identity: compatibility composition, white space collapsed, case folded; Spark has neither of the two foldings. A batch is
    folded a small piece at a time, so a worker holds little more than the batch that it was sent."""
    import unicodedata
    from itertools import accumulate

    import pyarrow.compute as pc

    fold = lambda t: " ".join(unicodedata.normalize("NFKC", t).split()).casefold() or None
    for texts in batches:
        ends, at = list(accumulate(n or 0 for n in pc.binary_length(texts).to_pylist())), 0
        while at < len(texts):
            to = max(at + 1, bisect_right(ends, FOLDED + (ends[at - 1] if at else 0)))
            yield pa.array([t if t is None else fold(t) for t in texts[at:to].to_pylist()], texts.type)
            at = to


def ascii_work_title(title: Column) -> Column:
    """The same for ASCII titles, inside the JVM."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(title, r"\s+", " "))), F.lit(""))
