"""Exact deduplication against a minimal perfect hash over the distinct digests of the rows seen before."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, keyed_text, materialize

#: Digests in a shard of the index, on average; a shard is built and looked up in one piece.
SHARD = 40_000
#: Digests in a bucket of a shard, on average; each bucket has one seed.
BUCKET = 4


def normalised(text: Column) -> Column:
    """Runs of space and the controls 9 to 13 become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _words(digests):
    """The first and second 64-bit word of 32-byte digests."""
    import numpy as np

    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)[:, :2].T if len(digests) else np.empty((2, 0), np.uint64)


def _slot(words, seeds, n: int):
    from .shingles import mix

    return mix(words ^ mix(seeds)) % n


def build(digests: list[bytes]) -> tuple[bytes, list[int]]:
    """A minimal perfect hash of distinct 32-byte digests: the seeds of its buckets, and each digest's slot.

    Hash and displace: the bucket of a digest comes from its second word. From the fullest bucket down, a bucket takes the
    first seed that sends all of its digests to slots that are still free.
    """
    import numpy as np

    n = len(digests)
    if not n:
        return b"", []
    one, two = _words(digests)
    buckets = max(1, -(-n // BUCKET))
    home = (two % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    starts = np.searchsorted(home[order], np.arange(buckets + 1))
    sizes = np.diff(starts)
    seeds, taken, slots = np.zeros(buckets, np.uint32), np.zeros(n, bool), np.zeros(n, np.int64)
    tries = np.arange(512, dtype=np.uint64)
    for b in np.argsort(-sizes, kind="stable").tolist():
        if not sizes[b]:
            break
        at = order[starts[b] : starts[b + 1]]
        base = 0
        while True:
            got = _slot(one[at][None, :], (tries + np.uint64(base))[:, None], np.uint64(n)).astype(np.int64)
            free = ~taken[got].any(axis=1)
            if len(at) > 1:
                g = np.sort(got, axis=1)
                free &= (g[:, 1:] != g[:, :-1]).all(axis=1)
            hit = int(free.argmax())
            if free[hit]:
                break
            base += len(tries)
            if base >= 1 << 31:
                raise ValueError("digests that share their first 128 bits can't be told apart")
        seeds[b], slots[at] = base + hit, got[hit]
        taken[got[hit]] = True
    return seeds.tobytes(), slots.tolist()


def find(seeds: bytes, n: int, digests: list[bytes]):
    """The slot of each digest, one that the hash was built for or not."""
    import numpy as np

    one, two = _words(digests)
    table = np.frombuffer(seeds, np.uint32)
    home = (two % np.uint64(len(table))).astype(np.int64)
    return _slot(one, table[home].astype(np.uint64), np.uint64(n)).astype(np.int64)


def _build_shards(batches: Iterator) -> Iterator:
    """Rows sorted by shard (shard, digest, winner, copies) to one row for each shard."""
    import numpy as np
    import pyarrow as pa

    def packed(shard: int, rows: list[tuple[bytes, int | None, int]]):
        seeds, slots = build([r[0] for r in rows])
        at = np.argsort(slots)
        held = b"".join(rows[i][0] for i in at)
        winners = np.array([rows[i][1] or 0 for i in at], "<i8").tobytes()
        known = np.array([rows[i][1] is not None for i in at], bool).tobytes()
        copies = np.array([rows[i][2] for i in at], "<i8").tobytes()
        return pa.RecordBatch.from_pylist([{"shard": shard, "n": len(rows), "seeds": seeds, "digests": held, "winners": winners, "known": known, "copies": copies}])

    shard, rows = None, []
    for batch in batches:
        for s, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != shard and rows:
                yield packed(shard, rows)
                rows = []
            shard = s
            rows.append(row)
    if rows:
        yield packed(shard, rows)


INDEX = "shard long, n long, seeds binary, digests binary, winners binary, known binary, copies binary"


def shard_of(d: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(d), F.lit(shards))


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """The index of (digest, winner, copies) rows with distinct digests: one row for each shard.

    A slot holds the full digest, the winner's locator (its doc_id), whether it has one, and how many rows have the digest.
    """
    rows = distinct.select(shard_of(F.col("digest"), shards).alias("shard"), "digest", "winner", "copies")
    return rows.repartition("shard").sortWithinPartitions("shard", "digest").mapInArrow(_build_shards, INDEX)


def _look_up(batches: Iterator) -> Iterator:
    """A shard's index row comes before the rows that are looked up in it; those stream past."""
    import numpy as np
    import pyarrow as pa

    shard = None
    for batch in batches:
        shards = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            part = batch.slice(i, j - i)
            if part.column(1)[0].as_py() == 0:
                shard, row = part.column(0)[0].as_py(), part.slice(0, 1).to_pylist()[0]
                n, seeds, held = row["n"], row["seeds"], row["digests"]
                winners, known, copies = (np.frombuffer(row[c], t) for c, t in (("winners", "<i8"), ("known", bool), ("copy_counts", "<i8")))
                part = part.slice(1)
            if not part.num_rows:
                continue
            wanted = part.column(2).to_pylist()
            if shard != part.column(0)[0].as_py():
                found, won, times = [False] * len(wanted), [None] * len(wanted), [None] * len(wanted)
            else:
                slots = find(seeds, n, wanted).tolist()
                found = [held[32 * s : 32 * s + 32] == d for s, d in zip(slots, wanted, strict=True)]
                won = [int(winners[s]) if ok and known[s] else None for s, ok in zip(slots, found, strict=True)]
                times = [int(copies[s]) if ok else None for s, ok in zip(slots, found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), part.column(4), pa.array(won, pa.int64()), pa.array(times, pa.int64())], names=["digest", "winner", "copies", "old_winner", "old_copies"])


def look_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, winner, copies, old_winner, old_copies) for rows (digest, winner, copies); old_* are null for nonmembers.

    A nonmember's slot holds some other digest; the bytes of both are compared, so none passes for a member.
    """
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("seeds", "binary"), ("digests", "binary"), ("winners", "binary"), ("known", "binary"), ("copy_counts", "binary"))]
    asked = rows.select(shard_of(F.col("digest"), shards).alias("shard"), F.lit(1).alias("kind"), "digest", "winner", "copies", *none)
    held = index.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("winner"), F.lit(None).cast("long").alias("copies"), "n", "seeds", "digests", "winners", "known", F.col("copies").alias("copy_counts"))
    both = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(_look_up, "digest binary, winner long, copies long, old_winner long, old_copies long")


def dedupe(docs: DataFrame, history: Column | None = None, shard: int = SHARD) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    history tells the rows that were there before from those that arrive (default: three quarters by a hash of doc_id, as
    in a crawl that grows by a third). The distinct digests of the former make up the index. The distinct digests of the
    latter are looked up in it: members join the group of their slot's winner, nonmembers form groups of their own. Of all
    rows of a group the one with the smallest doc_id stays.

    Only (digest, smallest doc_id, count), already summed within each task, are shuffled to build and search the index, so
    a text with any number of copies counts once. Null texts are empty texts. Rows that repeat a doc_id are rows of their
    own; both copies of the winner's row are marked as kept. A null doc_id stays only where no row of its group has one. Other columns are ignored; an empty table gives an empty result.
    """
    rows = keyed_text(docs).select("doc_id", digest(F.col("text")).alias("digest"))
    history = F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0 if history is None else history
    rows = materialize(rows.withColumn("old", F.coalesce(history, F.lit(False))), "digests")
    distinct = rows.groupBy("digest", "old").agg(F.min("doc_id").alias("winner"), F.count("*").alias("copies"))
    old, new = distinct.where("old"), distinct.where("not old")
    # One shard for each task at least, so that a small index is not built in one of them.
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // shard))
    index = build_index(old, shards)
    seen = look_up(new, index, shards)
    joined = seen.select("digest", F.least("winner", "old_winner").alias("keep_id"), (F.col("copies") + F.coalesce("old_copies", F.lit(0))).alias("group_size"))
    untouched = old.select("digest", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"))
    groups = joined.unionByName(untouched).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    out = rows.select("doc_id", "digest").join(groups, "digest")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all of their columns; of rows that repeat a kept doc_id each stays.
    Rows without a doc_id are told apart by their text. An empty table gives an empty result.

    The dropped ids are written and joined against: they are few and narrow beside the texts, which so need not be shuffled
    where Spark finds the ids small enough to send.
    """
    doc_id, key, text = F.col("doc_id").cast("long"), free_name(docs, "gone"), free_name(docs, "gone_text")
    named = dedupe(docs).select(F.col("doc_id").alias(key), F.when(F.col("doc_id").isNull(), F.unhex("text_sha256")).alias(text), "kept")
    gone = materialize(named.groupBy(key, text).agg(F.bool_or("kept").alias("kept")).where("not kept").select(key, text), "dropped")
    lost = gone.where(F.col(key).isNull()).select(text)
    out = docs.join(gone.where(F.col(key).isNotNull()).select(key), doc_id == F.col(key), "left_anti")
    if lost.isEmpty():
        return out
    return out.join(lost, doc_id.isNull() & (digest(F.col("text")) == F.col(text)), "left_anti")
