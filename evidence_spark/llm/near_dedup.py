"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, keyed_text, map_rows, materialize
from .components import connected_components

#: Slots in each band; 128 slots make 32 bands. A pair at similarity 0.75 shares none with probability 5e-6.
BAND_ROWS = 4
#: Documents that share a rare shingle and are compared in one piece. Of more, those of the largest component are dealt out in
#: pieces and the others are sent to each; where the others are as many themselves, all are dealt out as pairs of blocks.
BLOCK = 4096


def _signer():
    import hashlib

    import pyarrow as pa

    from .shingles import band_keys, shingle_set, super_minhash

    def step(batch):
        sizes, digests, keys, seen = [], [], [], {}
        for text in batch.column(1).to_pylist():
            items = shingle_set(text)
            sizes.append(len(items))
            if not len(items):
                digests.append(None)
                keys.append(None)
                continue
            digest = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
            if digest not in seen:
                seen[digest] = band_keys(super_minhash(items), BAND_ROWS)
            digests.append(digest)
            keys.append(seen[digest])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "keys"])

    return step


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys) of each row; digest and keys are null without a word."""
    return map_rows(keyed_text(docs), _signer, "doc_id long, n_shingles long, digest binary, keys array<long>")


def _verifier():
    from functools import lru_cache

    import numpy as np
    import pyarrow as pa

    from .shingles import shingle_set

    items = lru_cache(32)(shingle_set)

    def step(batch):
        keep = []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            x, y = items(left.as_py()), items(right.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both) > 0)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return step


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have a similarity of 0.75 or more."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return map_rows(pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb"), _verifier, "a long, b long")


def _shingler():
    import numpy as np
    import pyarrow as pa

    from .shingles import shingle_set

    def step(batch):
        sets = [shingle_set(text) for text in batch.column(1).to_pylist()]
        sizes = np.array([len(x) for x in sets])
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "n", "shingle"])

    return step


def _crossing(batches: Iterator) -> Iterator:
    """Pairs across components in each block pair (key, i, j) of sorted rows that could still be similar enough."""
    import numpy as np
    import pyarrow as pa

    def pairs(rows: np.ndarray, i: int, j: int):
        """rows: block, n, cap, component, rep. Those of a similar size are compared; pairs are handed on as they are found."""
        one = rows[rows[:, 0] == i]
        one = one[one[:, 1].argsort(kind="stable")]
        two = rows[rows[:, 0] == j] if i != j else one
        two = two[two[:, 1].argsort(kind="stable")]
        first = np.arange(1, len(one) + 1) if i == j else np.searchsorted(two[:, 1], -(-3 * one[:, 1] // 4))
        last = np.searchsorted(two[:, 1], 4 * one[:, 1] // 3, side="right")
        found, size = [], 0
        for k, (lo, hi) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            _, n, cap, comp, rep = one[k]
            rest = two[lo:hi]
            others = rest[(rest[:, 3] != comp) & (rest[:, 1] <= cap) & (rest[:, 2] >= n), 4]
            if len(others):
                found.append(np.stack([np.minimum(others, rep), np.maximum(others, rep)]))
                size += len(others)
            if size > 100_000:
                yield batch_of(found)
                found, size = [], 0
        yield batch_of(found)

    def batch_of(found: list):
        out = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        for part in np.split(rows, cuts):
            if held and (held[0][0, :3] != part[0, :3]).any():
                whole = np.concatenate(held)
                yield from pairs(whole[:, 3:], whole[0, 1], whole[0, 2])
                held = []
            held.append(part)
    if held:
        whole = np.concatenate(held)
        yield from pairs(whole[:, 3:], whole[0, 1], whole[0, 2])


def _rare_prefix_pairs(open_docs: DataFrame, texts: DataFrame, comps: DataFrame, block: int) -> DataFrame:
    """Every pair of open documents in different components that may reach 0.75, by an exact prefix filter.

    Order a set's n shingles from rare to frequent. Two sets at 0.75 share need = ceil(0.75 n) of them at least, so the first
    that they share stands among the first n - need + 1 of each. At the first that they share, at position p, at most n - p are
    in common, so n and the other's size sum to 7/3 (n - p) at most. A passage that many documents share stands last and so
    brings together only documents that it nearly fills.

    The shingles of a shared passage are shared by the same documents: of keys with the same documents the first in that order
    serves for all.
    """
    rows = materialize(map_rows(texts.join(open_docs, "doc_id", "left_semi"), _shingler, "rep long, n long, shingle long"), "shingles")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    # A set's own shingles come together here, those of one document; their number is that of its words.
    sets = rows.join(shared, "shingle").groupBy("rep").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    sets = sets.join(comps, F.col("rep") == F.col("node"), "left").select("rep", "n", "s", F.coalesce("component", "rep").alias("comp"), (F.col("n") - F.size("s")).alias("alone"))
    take = F.greatest(F.lit(0), F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1 - F.col("alone")).cast("int")
    spot = sets.select("rep", "n", "comp", "alone", F.posexplode(F.slice("s", F.lit(1), take)).alias("at", "x"))
    spot = spot.select(F.col("x.shingle").alias("key"), F.col("x.df").alias("df"), "rep", "n", "comp", (F.floor((F.col("n") - F.col("alone") - F.col("at")) * 7 / 3) - F.col("n")).alias("cap"))
    spot = materialize(spot, "prefixes")
    # The documents of a key are known by their number and two sums over them; sums of hashes combine within each task.
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "rep").cast("decimal(20,0)"))
    keys = spot.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("df").alias("df"), mark(1).alias("m1"), mark(2).alias("m2")).where("lo != hi")
    keys = materialize(keys.groupBy("size", "m1", "m2").agg(F.min_by("key", F.struct("df", "key")).alias("key")).select("key", "size"), "open-keys")
    small = spot.join(keys.where(F.col("size") <= block).select("key"), "key").select("key", *(F.lit(0).cast("long").alias(c) for c in ("i", "j", "own")), "n", "cap", "comp", "rep")
    dealt = small
    large = keys.where(F.col("size") > block)
    if not large.isEmpty():
        dealt = dealt.unionByName(_dealt(spot.join(large, "key"), block))
    out = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_crossing, "a long, b long").distinct()
    out = materialize(out, "candidates")
    discard(rows, spot, keys)
    return out


def _dealt(spot: DataFrame, block: int) -> DataFrame:
    """The rows of large keys (key, size, rep, n, comp, cap) as (key, i, j, own, ...): rows with own = i meet those with own = j.

    Pairs are sought across components alone. So the rows of a key's largest component are dealt out in blocks, and the others,
    which are block 0, are sent to each of these and meet each other once. Only where more than `block` are left besides the
    largest component are these dealt out too, and meet in pairs of blocks.
    """
    sizes = spot.groupBy("key", "size", "comp").agg(F.count("*").alias("c")).groupBy("key", "size").agg(F.max(F.struct("c", "comp")).alias("x"))
    rest = F.ceil((F.col("size") - F.col("x.c")) / block).cast("long")
    sizes = sizes.select("key", F.col("x.comp").alias("big"), rest.alias("few"), F.ceil(F.col("x.c") / block).cast("long").alias("many"))
    d = spot.join(sizes, "key").withColumn("main", F.col("comp") == F.col("big"))
    # Blocks 0 to few - 1 hold the others, those from few on the largest component.
    h = F.xxhash64("rep")
    d = d.withColumn("own", F.when(F.col("main"), F.col("few") + F.pmod(h, F.col("many"))).otherwise(F.pmod(h, F.col("few"))))
    others = F.sequence(F.lit(0).cast("long"), F.col("few") - 1)
    mates = F.when(F.col("main"), others).otherwise(F.concat(others, F.sequence(F.col("few"), F.col("few") + F.col("many") - 1)))
    d = d.withColumn("other", F.explode(mates))
    return d.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "n", "cap", "comp", "rep")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    1. Rows with the same set form a class, known by its smallest doc_id; only that row goes on.
    2. SuperMinHash signatures, 32 bands of 4 slots. In each bucket every member is paired with the smallest one only, and
       the pairs are verified on whole texts. Union-find gives components.
    3. Buckets that still hold more than one component may hide further links. Their members go through an exact prefix
       filter (see _rare_prefix_pairs), which yields pairs across components alone; these are verified too.

    A null, empty or wordless text has no shingle, links with nothing and is kept. Rows that repeat a doc_id count as one
    document; a null doc_id links with nothing but equal sets. Columns other than doc_id and text are ignored. An empty table gives an empty result.
    """
    texts = keyed_text(docs)
    signed = materialize(sign(docs), "signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("x"))
    classes = materialize(classes.select("digest", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), F.col("x.keys").alias("keys")), "classes")
    bands = classes.select("rep", "n", F.explode("keys").alias("key"))
    pivots = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.min(F.struct("rep", "n")).alias("p")).where("pivot != last").select("key", "pivot", F.col("p.n").alias("pn"))
    members = materialize(bands.join(pivots, "key"), "members")
    candidates = members.select(F.col("rep").alias("doc_id")).distinct()
    near_texts = materialize(texts.join(candidates, "doc_id", "left_semi"), "near-texts")
    pairs = members.where("rep != pivot and 4 * least(n, pn) >= 3 * greatest(n, pn)").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(verified(pairs, near_texts), "links")
    comps = connected_components(links)
    rest = members.where("rep != pivot").select("key", "rep").join(comps, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    open_keys = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    open_docs = rest.join(open_keys, "key", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    more = materialize(verified(_rare_prefix_pairs(open_docs, near_texts, comps, block), near_texts), "links")
    final = connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    discard(members, near_texts, links, more)
    named = classes.select("digest", "rep").join(final, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one document of each group, with all of their columns. Rows that repeat a doc_id stay or go
    together; rows without one stay, as do texts without a word. An empty table gives an empty result. The dropped ids are written and joined against, so that the texts need not be shuffled where Spark can send the ids.
    """
    found, key = near_duplicates(docs), free_name(docs, "gone")
    gone = materialize(found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept and doc_id is not null").select(F.col("doc_id").alias(key)), "dropped")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(key), "left_anti")
