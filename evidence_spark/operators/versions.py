"""Trees of versions: positions that tell ancestors apart by comparison, and states along a version's own line.

A rollback lets the next version branch off, so versions form trees. Listing the ancestors of all n versions of a chain takes
n * n / 2 rows; a position for each version takes n.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import discard, written


def labels(versions: DataFrame) -> DataFrame:
    """version_id, tree, depth, first, last of versions (version_id, prior_version_id) and of priors that have no row.

    tree is the root's version_id. A walk through the tree enters and leaves each version once; first and last are those steps,
    counted back from the walk's end, so that a is v or an ancestor of v if both are of one tree, a.first <= v.first and
    v.last <= a.last. A version without a prior, or its own prior, is a root; repeated rows count once; rows without version_id
    are no versions; an empty table gives an empty one. Two priors of one version, or a circle of them, are errors.

    A version finds its root first: as far as the rows beside it tell, then by doubling pointers, log2(depth) rounds over n rows. Trees
    of up to LOCAL versions are then walked whole within a task. A larger tree's walk is ranked by squaring pointers twice a round,
    log4(2n) rounds. Each step has one step before it, so no key of those joins is hot; steps that have found the end leave them.
    The children of one version are sorted by one task.
    """
    own = F.col("version_id")
    given = versions.where("version_id is not null").select(own.cast("string"), F.when(F.col("prior_version_id") != own, F.col("prior_version_id")).cast("string").alias("prior"))
    given = given.mapInArrow(_ahead, "version_id string, prior string, to string, done boolean")
    none = F.lit(None).cast("string")
    named = given.select("*", F.lit(1).alias("row")).unionByName(given.where("prior is not null").select(F.col("prior").alias("version_id"), none.alias("prior"), F.col("prior").alias("to"), F.lit(None).cast("boolean").alias("done"), F.lit(0).alias("row")))
    rows = named.groupBy("version_id").agg(F.max("prior").alias("prior"), F.min("prior").alias("other"), F.count("prior").alias("priors"), F.sum("row").alias("rows"), F.max(F.when(F.col("row") == 1, F.struct("done", "to"))).alias("up"))
    rows = rows.select("version_id", "prior", F.coalesce("up.to", "version_id").alias("to"), F.coalesce("up.done", F.lit(True)).alias("done"), ((F.col("other") != F.col("prior")) | ((F.col("priors") > 0) & (F.col("priors") < F.col("rows")))).alias("twice"))
    nodes = written(rows, "versions")
    twice = nodes.where("twice").first()
    if twice:
        raise ValueError(f"version {twice.version_id} has two priors")
    found = _roots(nodes.drop("twice"))
    large = [r[0] for r in found.groupBy("tree").count().where(F.col("count") > LOCAL).select("tree").collect()]  # n / LOCAL at most
    is_large = F.col("tree").isin(large) if large else F.lit(False)
    small = found.where(~is_large).select("tree", "version_id", "prior").repartition("tree").sortWithinPartitions("tree", "version_id")
    out = small.mapInArrow(_walks, "version_id string, tree string, depth long, first long, last long")
    if large:
        out = out.unionByName(_ranked(found.where(is_large).select("version_id", "prior")))
    out = written(out, "labels")
    discard(nodes, found)
    return out


#: Versions of a tree that one task walks, and rows that a task links before it hands them on.
LOCAL = 100_000


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (version_id, prior) with to, the farthest ancestor that the rows beside them tell, and done: it is a root."""

    def linked(held):
        t = pa.Table.from_batches(held)
        ids, priors = t.column(0).to_pylist(), t.column(1).to_pylist()
        up, top = dict(zip(ids, priors, strict=True)), {}
        for x in ids:
            path, on = [], set()
            while x not in top:
                if up.get(x) is None or x in on:  # a root, not among these rows, or a circle
                    top[x] = x
                else:
                    path.append(x)
                    on.add(x)
                    x = up[x]
            for y in path:
                top[y] = top[x]
        to = [top[x] for x in ids]
        done = [x in up and up[x] is None for x in to]
        yield from pa.table([*t.columns, pa.array(to, pa.string()), pa.array(done)], names=["version_id", "prior", "to", "done"]).to_batches(max_chunksize=10_000)

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= LOCAL:
            yield from linked(held)
            held, n = [], 0
    if held:
        yield from linked(held)


def _roots(nodes: DataFrame) -> DataFrame:
    """version_id, prior, tree of (version_id, prior, to, done): who has not found the root goes on from where its ancestor has come."""
    n, reach, found = nodes.count(), 1, nodes
    while waiting := found.where("not done").count():
        if reach > n:
            raise ValueError(f"versions that are their own ancestors, {found.where('not done').first().version_id} among them or after them")
        on = found.where("not done").select("version_id", "prior", "to")
        on = (F.broadcast(on) if waiting <= LOCAL else on).join(found.select(F.col("version_id").alias("to"), F.col("to").alias("to2"), "done"), "to")
        further = written(on.select("version_id", "prior", F.col("to2").alias("to"), "done").unionByName(found.where("done")), "roots")
        if found is not nodes:
            discard(found)
        found, reach = further, 2 * reach
    roots = found.select("version_id", "prior", F.col("to").alias("tree"))
    if found is not nodes:
        roots._stored_at = found._stored_at
    return roots


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of whole trees, whose rows (tree, version_id, prior) come one tree after the other, by version_id."""

    def walked(tree, ids, priors):
        at = {v: i for i, v in enumerate(ids)}
        up = [-1 if p is None else at[p] for p in priors]
        below: list[list[int]] = [[] for _ in ids]
        for i, p in enumerate(up):
            if p >= 0:
                below[p].append(i)
        order, depth, size, enter = [at[tree]], [0] * len(ids), [1] * len(ids), [0] * len(ids)
        for i in order:  # parents before children
            order.extend(below[i])
            for c in below[i]:
                depth[c] = depth[i] + 1
        for i in reversed(order):
            if up[i] >= 0:
                size[up[i]] += size[i]
        end = 2 * len(ids) - 1
        for i in order:
            step = enter[i] + 1
            for c in below[i]:
                enter[c] = step
                step += 2 * size[c]
        for i, v in enumerate(ids):
            out.append((v, tree, depth[i], enter[i] - end, enter[i] + 2 * size[i] - 1 - end))

    def batch():
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, ["version_id", "tree", "depth", "first", "last"])

    now, ids, priors, out = None, [], [], []
    for b in batches:
        for tree, v, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if tree != now and ids:
                walked(now, ids, priors)
                ids, priors = [], []
                if len(out) >= 10_000:
                    yield batch()
            now = tree
            ids.append(v)
            priors.append(p)
    if ids:
        walked(now, ids, priors)
    if out:
        yield batch()


def _ranked(nodes: DataFrame) -> DataFrame:
    """Labels of trees of any size, of (version_id, prior) without repeated rows or circles."""
    own = F.col("version_id")
    siblings = Window.partitionBy("prior").orderBy("version_id")
    inner = nodes.where("prior is not null").withColumn("right", F.lead("version_id").over(siblings)).withColumn("n", F.row_number().over(siblings))
    eldest = inner.where("n = 1").select(F.col("prior").alias("version_id"), F.col("version_id").alias("child"))
    enter, leave = (lambda c: F.concat(F.lit("+"), c)), (lambda c: F.concat(F.lit("-"), c))
    entries = nodes.join(eldest, "version_id", "left").select(enter(own).alias("step"), F.coalesce(enter(F.col("child")), leave(own)).alias("to"), F.lit(1).cast("long").alias("far"), F.lit(-1).cast("long").alias("up"), F.lit(False).alias("done"))
    exits = inner.select(leave(own).alias("step"), F.coalesce(enter(F.col("right")), leave(F.col("prior"))).alias("to"), F.lit(1).cast("long").alias("far"), F.lit(1).cast("long").alias("up"), F.lit(False).alias("done"))
    ends = nodes.where("prior is null").select(leave(own).alias("step"), leave(own).alias("to"), F.lit(0).cast("long").alias("far"), F.lit(0).cast("long").alias("up"), F.lit(True).alias("done"))

    def double(x: DataFrame) -> DataFrame:
        """Steps that have not found the end go on as far as the step that they point at has come."""
        y = x.select(F.col("step").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("up").alias("up2"), F.col("done").alias("done2"))
        on = x.where("not done").join(y, "to").select("step", F.col("to2").alias("to"), (F.col("far") + F.col("far2")).alias("far"), (F.col("up") + F.col("up2")).alias("up"), F.col("done2").alias("done"))
        return on.unionByName(x.where("done"))

    walk = written(entries.unionByName(exits).unionByName(ends), "walk")
    while not walk.where("not done").isEmpty():
        further = written(double(double(walk)), "walk")
        discard(walk)
        walk = further
    side = lambda sign: walk.where(F.col("step").startswith(sign))
    name = F.substring("step", 2, 2**30)
    first = side("+").select(name.alias("version_id"), F.substring("to", 2, 2**30).alias("tree"), (F.col("up") + 1).alias("depth"), (-F.col("far")).alias("first"))
    out = written(first.join(side("-").select(name.alias("version_id"), (-F.col("far")).alias("last")), "version_id"), "walked")
    discard(walk)
    return out


def descendants() -> Column:
    """Of a row of labels: how many versions follow on it."""
    return ((F.col("last") - F.col("first") - 1) / 2).cast("long")


def timeline(records: DataFrame, labelled: DataFrame, key: str = "ref_id") -> DataFrame:
    """key, tree, begin, end, lifecycle_id, status, reason, created_seq: what holds for a key at the positions begin <= first < end.

    records: key, lifecycle_id, status, reason, effective_version_id, created_seq. For a version, the record of the greatest
    (created_seq, lifecycle_id) holds among those bound to it or to an ancestor. Records that are not bound, or bound to unknown
    versions, or without a key, hold nowhere. Each record gives at most two rows, whatever the number of versions.

    One candidate for each key and version is left before rows meet. The rows of a key and tree pass one task in order; it
    keeps the stretches that are open, one within another.
    """
    last = records.where(F.col("effective_version_id").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), F.col("effective_version_id").alias("version_id"))
    last = last.agg(F.max_by(F.struct("lifecycle_id", "status", "reason", "created_seq"), F.struct("created_seq", "lifecycle_id")).alias("r"))
    rows = last.join(labelled.select("version_id", "tree", "first", "last"), "version_id").select("key", "tree", "first", "last", "r.*")
    rows = rows.repartition("key", "tree").sortWithinPartitions("key", "tree", "first").select(F.col("key").cast("string").alias("k"), "tree", "first", "last", "lifecycle_id", "status", "reason", "created_seq")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("lifecycle_id", "status", "reason", "created_seq"))
    cut = rows.mapInArrow(_stretches, f"k string, tree string, begin long, end long, {kinds}")
    return cut.select(F.col("k").cast(records.schema[key].dataType).alias(key), "tree", "begin", "end", "lifecycle_id", "status", "reason", "created_seq")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Disjoint stretches of rows that are sorted by k, tree and first and lie within or beside one another."""
    at, since, open_, out = None, 0, [], []  # open_: (last, rank, record) of what is open, each with the greatest rank so far

    def until(end):
        nonlocal since
        if open_ and since < end:
            out.append((*at, since, end, *open_[-1][2]))
        since = end

    def close(before):
        while open_ and (before is None or open_[-1][0] < before):
            until(open_[-1][0])
            open_.pop()

    def batch():
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, ["k", "tree", "begin", "end", "lifecycle_id", "status", "reason", "created_seq"])

    kinds = None
    for b in batches:
        kinds = b.schema.types
        for k, tree, first, last, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != (k, tree):
                close(None)
                at, since = (k, tree), first
            close(first)
            until(first)
            rank = (r[3] is not None, r[3], r[0] or "")
            above = open_[-1] if open_ else None
            open_.append((last, *above[1:]) if above and above[1] > rank else (last, rank, r))
        if out:
            yield batch()
    close(None)
    if out:
        yield batch()


def states_at(stretches: DataFrame, at: DataFrame, key: str = "ref_id") -> DataFrame:
    """version_id, key, lifecycle_id, status, reason, created_seq: what holds at each version of at (rows of labels()).

    A position lies in one block of each power of 16, a stretch is the sum of at most 30 of each: the join is on equal blocks. Blocks
    of 16 at a stretch's edges may lie partly outside, so a stretch makes at most 32 rows that are no rows of the result.
    """
    most = at.agg(F.max(-F.col("first"))).first()[0]
    if most is None:
        return at.select("version_id").join(stretches.select(key, "lifecycle_id", "status", "reason", "created_seq"), F.lit(False))
    levels = max(1, -(-(int(most) + 1).bit_length() // 4))
    floor = lambda x, n: F.shiftright(x, 4 * n)
    ceil = lambda x, n: -F.shiftright(-x, 4 * n)

    def blocks(level: int) -> Column:
        """What is not part of a whole block above, of the blocks that the stretch meets, rounded up and down to this level."""
        lo, hi = ceil(floor(F.col("lo"), 1), level - 1), floor(floor(F.col("hi") - 1, 1) + 1, level - 1)
        up, down = ceil(lo, 1) * 16, floor(hi, 1) * 16
        some = lambda a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(level).alias("level"), x.alias("block"))))
        if level == levels:
            return F.array(some(lo, hi))
        return F.when(up < down, F.array(some(lo, up), some(down, hi))).otherwise(F.array(some(lo, hi)))

    parts = stretches.withColumn("lo", F.greatest("begin", F.lit(-most))).withColumn("hi", F.least("end", F.lit(1))).where("lo < hi")
    parts = parts.select("tree", key, "lifecycle_id", "status", "reason", "created_seq", "lo", "hi", F.inline(F.flatten(F.array_compact(F.concat(*map(blocks, range(1, levels + 1)))))))
    points = at.select("version_id", "tree", "first", F.inline(F.array(*(F.struct(F.lit(n).alias("level"), floor(F.col("first"), n).alias("block")) for n in range(1, levels + 1)))))
    return points.join(parts, ["tree", "level", "block"]).where("lo <= first and first < hi").select("version_id", key, "lifecycle_id", "status", "reason", "created_seq")
