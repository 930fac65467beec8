"""Importance resampling towards a target's distribution: hashed features, integer scores, an exact histogram of scores."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 10_000
#: Words that a document needs to be drawn, and the share that is drawn, in percent.
LEAST_WORDS, PERCENT = 20, 25
#: Bytes of a long text that are cut into words at a time.
PIECE = 1 << 20

#: A byte's sign in a word: digits, a-z, A-Z as a-z and all that is not ASCII; the rest parts words.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def features(text: bytes) -> Iterator:
    """(words, buckets) by piece of a UTF-8 text: the buckets of all words and of all pairs of neighbours, repeats included."""
    at, last = 0, []
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        words = text[at:end].translate(_FOLD).split()
        at = end
        if not words:
            continue
        one = list(map(zlib.crc32, words))
        # A pair's sum goes on from that of its first word.
        before = list(map(zlib.crc32, itertools.repeat(b" "), last + one[:-1]))
        two = list(map(zlib.crc32, words if last else words[1:], before))
        last = one[-1:]
        yield len(words), np.array(one + two, np.int64) % BUCKETS


def _texts(batch, column: int):
    for at in range(0, batch.num_rows, 500):
        yield from batch.column(column).slice(at, 500).cast(pa.binary()).to_pylist()


def _count(batches: Iterator) -> Iterator:
    """The sum of each bucket that a task has seen."""
    sums = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in _texts(batch, 0):
            for _, at in features(text):
                sums += np.bincount(at, minlength=BUCKETS)
    full = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): the features of all texts by bucket; a task hands on at most one row for each bucket."""
    return texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> list[int]:
    """By bucket, floor(1000 * ln of how much likelier it is in the target), one added to each count."""
    s, t = bucket_counts(docs).withColumnRenamed("n", "s"), bucket_counts(target).withColumnRenamed("n", "t")
    both = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    rows = both.toArrow()  # BUCKETS rows
    s, t = (rows.column(c).to_numpy().astype(np.float64) for c in ("s", "t"))
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    out = [0] * BUCKETS
    for bucket, r in zip(rows.column("bucket").to_pylist(), ratio.tolist(), strict=True):
        out[bucket] = math.floor(1000 * math.log(r))
    return out


def _weigh(shared):
    def run(batches: Iterator) -> Iterator:
        gain = np.array(shared.value, np.int64)
        for batch in batches:
            words, counts, weights = [], [], []
            for text in _texts(batch, 1):
                n = k = total = 0
                for w, at in features(text):
                    n, k, total = n + w, k + len(at), total + int(gain[at].sum())
                words.append(n)
                counts.append(k)
                weights.append(total // k if k else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, counts, weights))], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each row's features, gains looked up in an array of BUCKETS."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_weigh(shared), "doc_id long, n_words long, n_features long, weight long")


def draw(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """scored with a column rank: 1, 2, 3 for the highest scores of the rows that are eligible, null for rows that are not drawn.

    Scores are integers, so their histogram is exact and small. Counts summed from the highest score down give each score the
    rank that its first row takes, and tell the score at which the draw ends. Only rows at or above it are shuffled, by score,
    and numbered by doc_id within it; no row is compared with all others.
    """
    counts = scored.where("eligible").groupBy("score").agg(F.count("*").alias("n")).toArrow()  # integer scores: some ten thousands of values, whatever the number of rows
    score, n = (counts.column(k).to_numpy().astype(np.int64) for k in range(2))
    order = np.argsort(-score)
    score, n = score[order], n[order]
    above, drawn = np.cumsum(n) - n, int(n.sum()) * percent // 100
    reached = above < drawn
    rank = F.lit(None).cast("long")
    if not reached.any():
        return scored.withColumn("rank", rank)
    cutoff = int(score[reached].min())
    offsets = scored.sparkSession.createDataFrame(pa.table({"_at": score[reached], "_above": above[reached]}))
    survives = F.col("eligible") & (F.col("score") >= cutoff)
    numbered = scored.where(survives).join(F.broadcast(offsets), F.col("score") == F.col("_at"))
    w = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    numbered = numbered.withColumn("rank", F.col("_above") + F.row_number().over(w)).drop("_at", "_above")
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return numbered.unionByName(scored.where(~survives).withColumn("rank", rank))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row for each row of docs: a draw without replacement whose chances follow
    how much likelier the target (text) is to hold the row's features.

    Features are words and pairs of neighbours, hashed into BUCKETS. Scores add Gumbel noise seeded by doc_id to the weight, so
    that the highest scores are the draw. Null and empty texts have no feature, weight 0, and are not eligible. Rows that repeat
    a doc_id share its noise and are drawn each for itself; rows without one share the noise of an empty id and come first among
    equal scores. Other columns are not read. With an empty target all gains are those of the prior; an empty table gives an
    empty result, one without an eligible row draws none.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weigh(docs, gains(docs, target)).select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    return draw(materialize(scored, "scored"), percent).select("doc_id", "n_features", "weight", "score", "rank")
