"""A content-addressed store of token ids: chunks cut by a rolling hash, document recipes and Merkle manifests.

Layout under one folder, all Parquet:
  chunks/kind=chunk     part, digest (sha256 of the chunk's bytes), width (bytes of an id: 2 or 4), data; each digest once
  chunks/kind=manifest  part, digest (Merkle root of the part's chunk digests in ascending order), n (chunks)
  recipes               part, doc_id, start (ids before it in its part), n_tokens, digests, lengths, digest (sha256 of the
                        others but part); ascending by doc_id
  totals                part, base (ids in the parts before), n (recipes), root (Merkle root of the part's recipe digests)
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, keyed_text, map_rows, materialize, new_path

#: Ids in the rolling window; ids between cuts on average (a power of two), at least and at most.
ROLL, MEAN, LEAST, MOST = 16, 1024, 256, 8192
#: Bytes of ids in a part of the store, about, at most.
PART = 128 << 20
#: Digests that a task remembers, to hand on a chunk's bytes once; others are handed on again and dropped later.
SEEN = 200_000


def cuts(ids) -> list[int]:
    """Ends of the chunks of an id array. An end depends on the ROLL ids before it, so equal passages are cut alike."""
    import numpy as np

    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    from .shingles import mix

    base, inverse = _powers(n)
    with np.errstate(over="ignore"):
        mixed = _mixed()[ids] if int(ids.max()) < 1 << 16 else mix(ids.astype(np.uint64) + np.uint64(1))
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(np.multiply(mixed, base[:n], out=mixed), out=prefix[1:])
        rolled = (prefix[ROLL:] - prefix[:-ROLL]) * inverse[: n - ROLL + 1]
    marks = (np.flatnonzero(mix(rolled) & np.uint64(MEAN - 1) == 0) + ROLL).tolist()
    out, last = [], 0
    for at in [*marks, n]:
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST and at < n:
            out.append(at)
            last = at
    return [*out, n] if last < n else out


@functools.cache
def _mixed():
    """mix(id + 1) of each id of 16 bits."""
    import numpy as np

    from .shingles import mix

    return mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


@functools.cache
def _power_table(size: int):
    import numpy as np

    b = 0x9E3779B97F4A7C15
    inv = pow(b, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64)))) for x in (b, inv))


def _powers(n: int):
    size = 1 << 12
    while size < n:
        size *= 2
    return _power_table(size)


def merkle_root(digests: list[bytes]) -> bytes:
    """SHA-256 tree: a parent hashes its two children; an odd one out moves up."""
    import hashlib

    level = list(digests) or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Roots:
    """The same root from a stream of digests in logarithmic space."""

    def __init__(self):
        self.held: list[tuple[int, bytes]] = []
        self.n = 0

    def add(self, digest: bytes) -> None:
        import hashlib

        self.n += 1
        size = 1
        while self.held and self.held[-1][0] == size:
            digest = hashlib.sha256(self.held.pop()[1] + digest).digest()
            size *= 2
        self.held.append((size, digest))

    def root(self) -> bytes:
        import hashlib

        if not self.held:
            return b""
        out = self.held[-1][1]
        for _, left in reversed(self.held[:-1]):
            out = hashlib.sha256(left + out).digest()
        return out


STAGED = "doc_id long, n_tokens long, digests array<binary>, lengths array<int>, digest binary, width int, data binary"


def _encoder(path: str, end: int):
    def make():
        import hashlib

        import numpy as np
        import pyarrow as pa

        from .common import word_bpe

        seen: set[bytes] = set()
        tail = np.array([end], "<u4").tobytes()
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary()]
        names = [x.split()[0] for x in STAGED.split(", ")]

        def step(batch):
            coder = word_bpe(path)
            recipes, chunks = [[] for _ in range(4)], [[] for _ in range(3)]
            for doc_id, raw in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw + tail, "<u4")
                digests, lengths, at = [], [], 0
                small = ids.astype("<u2") if int(ids.max()) < 1 << 16 else None
                for to in cuts(ids):
                    data = (ids if small is None else small)[at:to].tobytes()
                    width = 4 if small is None else 2
                    digest = hashlib.sha256(bytes([width]) + data).digest()
                    digests.append(digest)
                    lengths.append(to - at)
                    at = to
                    if digest not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                        for col, value in zip(chunks, (digest, width, data), strict=True):
                            col.append(value)
                for col, value in zip(recipes, (doc_id, len(ids), digests, lengths), strict=True):
                    col.append(value)
            n, m = len(recipes[0]), len(chunks[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(recipes, kinds[:4], strict=True)), *(pa.nulls(n, t) for t in kinds[4:])], names=names)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in kinds[:4]), *(pa.array(c, t) for c, t in zip(chunks, kinds[4:], strict=True))], names=names)

        return step

    return make


STORED = "kind string, part long, n long, digest binary, width int, data binary"


def _unique(batches: Iterator) -> Iterator:
    """Rows sorted by digest: the first of each is stored, and at the end the part's manifest."""
    import pyarrow as pa
    from pyspark import TaskContext

    names = [x.split()[0] for x in STORED.split(", ")]
    part, last, roots = TaskContext.get().partitionId(), None, Roots()
    for batch in batches:
        keep = []
        for digest in batch.column(0).to_pylist():
            keep.append(digest != last)
            if digest != last:
                roots.add(digest)
            last = digest
        batch = batch.filter(pa.array(keep, pa.bool_()))
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * n, pa.string()), pa.array([part] * n, pa.int64()), pa.nulls(n, pa.int64()), *batch.columns], names=names)
    if roots.n:
        yield pa.RecordBatch.from_arrays([pa.array(["manifest"]), pa.array([part]), pa.array([roots.n]), pa.array([roots.root()], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names=names)


RECIPES = "part long, doc_id long, start long, n_tokens long, digests array<binary>, lengths array<int>"


TOTALS = "part long, base long, n long, root binary"


def recipe_digest():
    """The digest of a recipe, from all that it says."""
    lists = [F.array_join(F.transform("digests", F.hex), ","), F.array_join(F.transform("lengths", lambda x: x.cast("string")), ",")]
    return F.unhex(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_id", "start", "n_tokens")), *lists), 256))


def recipe_roots(spark: SparkSession, path: str) -> DataFrame:
    """(part, n, root) of the recipes as read; their digests are computed anew."""
    digests = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("part", recipe_digest().alias("digest"), "start")
    return digests.repartition("part").sortWithinPartitions("part", "start", "digest").mapInArrow(_check_roots, "part long, n long, root binary")


def _running(batches: Iterator) -> Iterator:
    """Adds the part's number and the ids before each row in it."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(1).to_numpy(zero_copy_only=False)
        ends = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int64()), batch.column(0), pa.array(ends - n), *batch.columns[1:]], names=[x.split()[0] for x in RECIPES.split(", ")])
        before = int(ends[-1]) if len(n) else before


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None, end: int = 1) -> str:
    """Encode docs, each followed by the end id, and write the store. Returns its folder, in the shared one by default.

    One pass encodes and cuts every text and stages the recipes and, once for each task, the chunks. Chunks are then dealt
    out by digest, sorted and stored once; recipes are dealt out by ranges of doc_id. A chunk that a third of all documents
    share is staged once by each task, so no task of the second step gets more than one copy from each of the first.
    Null and empty texts hold the end id alone. Rows that repeat a doc_id, or have none, have recipes of their own, in the order of their
    chunks' digests; those without one come first. An empty table gives a store without rows.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    staged = materialize(map_rows(keyed_text(docs), _encoder(tokenizer, end), STAGED), "staged")
    # Recipes and chunks lie in one table with other columns each, so reading either reads no bytes of the other.
    chunks = staged.where("digest is not null").select("digest", "width", "data")
    # As many parts as the shuffle has partitions, and more where a part would get over PART bytes of ids.
    total = staged.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * total // PART))
    unique = chunks.repartition(parts, "digest").sortWithinPartitions("digest").mapInArrow(_unique, STORED)
    unique.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/chunks")
    recipes = staged.where("digests is not null").select("doc_id", "n_tokens", "digests", "lengths")
    recipes = recipes.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "digests").mapInArrow(_running, RECIPES)
    recipes.withColumn("digest", recipe_digest()).write.option("compression", "zstd").parquet(f"{path}/recipes")
    # One row for each part: some thousands for a terabyte of text.
    sums = spark.read.schema(RECIPES).parquet(f"{path}/recipes").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    roots = {r.part: (r.n, r.root) for r in recipe_roots(spark, path).collect()}
    base, rows = 0, []
    for part, n in sorted(sums):
        rows.append((part, base, *roots[part]))
        base += n
    spark.createDataFrame(rows, TOTALS).coalesce(1).write.parquet(f"{path}/totals")
    discard(staged)
    return path


CHUNKS = "part long, n long, digest binary, width int, data binary, kind string"


def read_chunks(spark: SparkSession, path: str, kind: str = "chunk") -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(f"{path}/chunks").where(F.col("kind") == kind)


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, digests, lengths) with start counted over the whole store."""
    totals = spark.read.schema("part long, base long").parquet(f"{path}/totals")  # one row for each part
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    return recipes.join(F.broadcast(totals), "part").select("part", "doc_id", F.col("start").alias("at"), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "digests", "lengths")


def _chunk_sums():
    import hashlib
    import zlib

    import numpy as np
    import pyarrow as pa

    def step(batch):
        crcs, sizes, digests = [], [], []
        for width, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            digests.append(hashlib.sha256(bytes([width]) + data).digest())
            crcs.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
            sizes.append(len(data) // width)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], names=["part", "digest", "crc", "n"])

    return step


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """(part, digest, crc, n) from the bytes of each stored chunk: digests are computed anew, crc is of its ids as 32 bits."""
    return map_rows(read_chunks(spark, path).select("part", "width", "data"), _chunk_sums, "part long, digest binary, crc long, n long")


def _check_roots(batches: Iterator) -> Iterator:
    import pyarrow as pa

    part, roots = None, Roots()
    for batch in batches:
        for p, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if p != part and roots.n:
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([roots.n]), pa.array([roots.root()], pa.binary())], names=["part", "n", "root"])
                roots = Roots()
            part = p
            roots.add(digest)
    if roots.n:
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([roots.n]), pa.array([roots.root()], pa.binary())], names=["part", "n", "root"])


def bad_parts(sums: DataFrame, path: str) -> DataFrame:
    """(part) of parts whose chunks, as read, do not give the manifest's Merkle root and count."""
    spark = sums.sparkSession
    found = sums.select("part", "digest").repartition("part").sortWithinPartitions("part", "digest").mapInArrow(_check_roots, "part long, n long, root binary")
    want = read_chunks(spark, path, "manifest").select("part", F.col("n").alias("want_n"), F.col("digest").alias("want"))
    return _differing(want, found)


def bad_recipe_parts(spark: SparkSession, path: str) -> DataFrame:
    """(part) of parts whose recipes, as read, do not give the root and count in totals."""
    want = spark.read.schema(TOTALS).parquet(f"{path}/totals").select("part", F.col("n").alias("want_n"), F.col("root").alias("want"))
    return _differing(want, recipe_roots(spark, path))


def _differing(want: DataFrame, found: DataFrame) -> DataFrame:
    return want.join(found, "part", "full_outer").where("not (n <=> want_n and root <=> want)").select("part")


def verify(sums: DataFrame, path: str) -> None:
    """Raises where chunks or recipes were lost, added or changed. sums: chunk_sums()."""
    if not bad_parts(sums, path).isEmpty():
        raise ValueError("stored chunks differ from the manifest")
    if not bad_recipe_parts(sums.sparkSession, path).isEmpty():
        raise ValueError("stored recipes differ from the manifest")


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of CRC-32, bits in reflected order."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = b >> 1 ^ 0xEDB88320 if b & 1 else b >> 1
    return out


@functools.cache
def _power(n_bytes: int) -> int:
    """x to the power of 8 n: what n further zero bytes multiply a CRC by."""
    out, square = 1 << 31, 1 << 23  # x to the powers 0 and 8
    while n_bytes:
        if n_bytes & 1:
            out = _times(square, out)
        square = _times(square, square)
        n_bytes >>= 1
    return out


def crc32_join(left: int, right: int, right_bytes: int) -> int:
    """The CRC-32 of two strings, from those of each and the length of the second."""
    return _times(_power(right_bytes), left) ^ right


def _joiner():
    import pyarrow as pa

    def step(batch):
        parts, crcs = batch.column(3), []
        values = parts.flatten()
        found, sizes = values.field("crc").to_pylist(), values.field("n").to_pylist()
        at = 0
        for n in parts.value_lengths().to_pylist():
            crc = found[at]
            for k in range(at + 1, at + n):
                crc = crc32_join(crc, found[k], 4 * sizes[k])
            at += n
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return step


def document_sums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored document, from the store's files alone.

    The CRC of a document is joined from those of its chunks, each computed from the bytes read; a chunk's bytes need not
    travel to every document that holds it. Raises where a chunk is missing, or has other bytes than its digest or manifest
    says, and where recipes differ from theirs.
    """
    sums = materialize(chunk_sums(spark, path), "chunk-sums")
    verify(sums, path)
    wanted = read_recipes(spark, path).select("doc_id", "start", "n_tokens", "lengths", F.posexplode("digests").alias("at", "digest"))
    found = wanted.join(sums.select("digest", "crc", "n"), "digest", "left").select("doc_id", "start", "n_tokens", F.struct("at", "crc", "n", (F.get("lengths", "at") != F.col("n")).alias("bad")).alias("x"))
    docs = found.groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list("x")).alias("parts"))
    docs = docs.withColumn("parts", F.when(F.exists("parts", lambda p: p["crc"].isNull() | p["bad"]), F.raise_error(F.lit("a chunk is missing or has another length"))).otherwise(F.col("parts")))
    return map_rows(docs, _joiner, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): whole documents, ids as little-endian 32-bit.

    Raises where chunks or recipes differ from their manifests. Each chunk is held against its digest and length once more
    where it is joined, and each document against its number of ids.
    """

    def make():
        import hashlib

        import numpy as np
        import pyarrow as pa

        def piece(x):
            if x["data"] is None:
                raise ValueError("a chunk is missing")
            if hashlib.sha256(bytes([x["width"]]) + x["data"]).digest() != x["digest"] or len(x["data"]) != x["width"] * x["length"]:
                raise ValueError("a chunk differs from its digest or length")
            return np.frombuffer(x["data"], f"<u{x['width']}").astype("<u4").tobytes()

        def step(batch):
            out = [b"".join(map(piece, parts)) for parts in batch.column(3).to_pylist()]
            if any(len(x) != 4 * n for x, n in zip(out, batch.column(2).to_pylist(), strict=True)):
                raise ValueError("a document has another number of ids than its recipe says")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

        return step

    verify(chunk_sums(spark, path), path)
    wanted = read_recipes(spark, path).select("doc_id", "start", "n_tokens", "lengths", F.posexplode("digests").alias("at", "digest")).withColumn("length", F.get("lengths", "at"))
    found = wanted.join(read_chunks(spark, path).select("digest", "width", "data"), "digest", "left").groupBy("doc_id", "start", "n_tokens")
    docs = found.agg(F.sort_array(F.collect_list(F.struct("at", "digest", "length", "width", "data"))).alias("parts"))
    return map_rows(docs, make, "doc_id long, start long, n_tokens long, ids binary")
