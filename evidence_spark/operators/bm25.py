"""Okapi BM25 over chunk payloads: a forward index that is written once, and block search over it.

Statistics cover the whole index, both levels, before any filter. A stated set of queries is answered in blocks: the weights
of a block's terms go to the tasks, each task multiplies its chunks with them and hands on its k best for each query. No
posting is shuffled, so a word that every chunk has costs no more than another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..config import DEFAULT, Config
from ..functions.text import keyword_tokens
from ..tables import local, written
from .best import FOUND, Best

#: Queries in a block, on average; decimal digits of a score; doubles in a task's matrix; terms that are sent to the tasks to
#: restrict an index to them: beyond that all terms are kept.
BLOCK, DIGITS, CELLS, SENT = 256, 9, 1_000_000, 200_000

FORWARD = "chunk_id string, ref_id string, level string, dl int, terms array<string>, tfs array<int>"


def query_terms(queries: DataFrame, tokenizer: Callable[[Column], Column] = keyword_tokens) -> DataFrame:
    """query_id, term, qtf: a term that a query repeats counts each time."""
    return queries.select("query_id", F.explode(tokenizer(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def term_stats(chunks: DataFrame, tokenizer: Callable[[Column], Column] = keyword_tokens) -> DataFrame:
    """term, df (chunks), cf (occurrences): counted in one pass and one aggregation, without a table of postings."""
    t = chunks.select(tokenizer(F.col("payload")).alias("t"))
    one = lambda df, cf: lambda term: F.struct(term.alias("term"), F.lit(df).alias("d"), F.lit(cf).alias("c"))
    rows = t.select(F.inline(F.concat(F.transform("t", one(0, 1)), F.transform(F.array_distinct("t"), one(1, 0)))))
    return rows.groupBy("term").agg(F.sum("d").alias("df"), F.sum("c").alias("cf"))


def _counter(wanted: list[str] | None):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keys = None if wanted is None else pa.array(wanted, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = batch.column(3)
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                row = np.repeat(np.arange(len(size)), size)
                if keys is None:
                    coded = flat.dictionary_encode()
                    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                else:
                    names, code = keys, pc.index_in(flat, value_set=keys).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                    row, code = row[code >= 0], code[code >= 0]
                base = max(1, len(names))
                pair, tf = np.unique(row * base + code, return_counts=True)
                ends = np.searchsorted(pair, np.arange(len(size) + 1) * base).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(pair % base)))
                tfs = pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size.astype(np.int32)), terms, tfs], names=["chunk_id", "ref_id", "level", "dl", "terms", "tfs"])

    return run


def forward_index(chunks: DataFrame, tokenizer: Callable[[Column], Column] = keyword_tokens, terms: list[str] | None = None) -> DataFrame:
    """One row for each chunk: its length and, for each of its distinct terms (of those given, if so), how often it has it."""
    return chunks.select("chunk_id", "ref_id", "level", tokenizer(F.col("payload")).alias("t")).mapInArrow(_counter(terms), FORWARD)


@dataclass
class Index:
    """A forward index as a table, and how its texts were tokenized. Documents are added by writing more rows."""

    forward: DataFrame
    tokenizer: Callable[[Column], Column] = keyword_tokens

    @classmethod
    def store(cls, chunks: DataFrame, path: str, tokenizer: Callable[[Column], Column] = keyword_tokens, mode: str = "errorifexists") -> Index:
        """Write the index of chunks into path/forward, after what is there with mode append."""
        forward_index(chunks, tokenizer).write.mode(mode).parquet(f"{path}/forward")
        return cls.load(chunks.sparkSession, path, tokenizer)

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokenizer: Callable[[Column], Column] = keyword_tokens) -> Index:
        return cls(spark.read.schema(FORWARD).parquet(f"{path}/forward"), tokenizer)

    @classmethod
    def for_queries(cls, queries: DataFrame, chunks: DataFrame, tokenizer: Callable[[Column], Column] = keyword_tokens) -> Index:
        """An index of the terms of a stated set of queries, written to the shared folder, where they are few enough to send."""
        terms = [r[0] for r in query_terms(queries, tokenizer).select("term").distinct().limit(SENT + 1).collect()]
        return cls(written(forward_index(chunks, tokenizer, terms if len(terms) <= SENT else None), "bm25-index"), tokenizer)


@dataclass
class Block:
    """The queries of a block, their terms, and the weight of each term for each query."""

    ids: list
    terms: list[str]
    weights: object
    avgdl: float
    k1: float
    b: float

    def sparse(self, batch, first: int):
        """(row, term, part) of the postings of a batch (…, dl, terms, tfs), dl being column number first."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = batch.column(first + 1)
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        code = pc.index_in(lists.flatten(), value_set=pa.array(self.terms, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        tf = batch.column(first + 2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        dl = np.maximum(batch.column(first).to_numpy(zero_copy_only=False), 1)[row]
        part = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl))
        seen = code >= 0
        return row[seen], code[seen], part[seen]


class Search:
    """A stated set of queries over an index. Term and corpus statistics are counted once; what is kept on the driver is one
    block's weights at a time."""

    def __init__(self, queries: DataFrame, index: Index, config: Config = DEFAULT):
        self.queries, self.index, self.config = queries, index, config
        self.kind = queries.schema["query_id"].dataType
        terms = query_terms(queries, index.tokenizer)
        n, total = index.forward.agg(F.count("*"), F.sum("dl")).first()
        self.avgdl = (total or 0) / n if n else 0.0
        df = index.forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        self.weights = written(terms.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("w")), "bm25-weights")

    def blocks(self, queries: DataFrame | None = None) -> Iterator[tuple[Block, Column]]:
        """Each block, and the condition on query_id that its queries meet."""
        import numpy as np

        weights = self.weights if queries is None else self.weights.join(queries.select("query_id").distinct(), "query_id", "left_semi")
        total = weights.select("query_id").distinct().count()
        passes = -(-total // BLOCK)
        for p in range(passes):
            mine = F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p
            rows = weights.where(mine).collect()  # the words of about BLOCK queries
            ids, terms = sorted({r.query_id for r in rows}), sorted({r.term for r in rows})
            q, t = {x: i for i, x in enumerate(ids)}, {x: i for i, x in enumerate(terms)}
            w = np.zeros((len(terms), len(ids)))
            for r in rows:
                w[t[r.term], q[r.query_id]] = r.w
            yield Block(ids, terms, w, self.avgdl or 1.0, self.config.bm25_k1, self.config.bm25_b), mine

    def _schema(self) -> StructType:
        return StructType([StructField("query_id", self.kind), *StructType.fromDDL(FOUND)])

    def _arrow_ids(self, ids: list):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array(ids, to_arrow_type(self.kind))

    def _empty(self) -> DataFrame:
        return local(self.queries.sparkSession, [], self._schema())

    def top(self, k: int, level: str | None = None, refs: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
        """query_id, chunk_id, ref_id, score, rank: the k best chunks of each query (of those given, if so) with a score above
        zero. refs (ref_id): documents that may be returned."""
        rows = self.index.forward
        if level:
            rows = rows.where(F.col("level") == level)
        if refs is not None:
            rows = rows.join(refs.select("ref_id").distinct(), "ref_id", "left_semi")
        rows, out = rows.select("chunk_id", "ref_id", "dl", "terms", "tfs"), self._empty()
        for block, _ in self.blocks(queries):
            out = out.unionByName(rows.mapInArrow(self._searcher(block, k), self._schema()))
        return ranked(out, k)

    def _searcher(self, block: Block, k: int):
        ids = self._arrow_ids(block.ids)

        def run(batches: Iterator) -> Iterator:
            import numpy as np

            best, step = Best(len(block.ids), k), max(16, CELLS // max(1, len(block.terms)))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    row, term, part = block.sparse(batch, 2)
                    tf = np.zeros((batch.num_rows, len(block.terms)))
                    tf[row, term] = part
                    scores = np.round(tf @ block.weights, DIGITS)
                    scores[scores <= 0] = -np.inf
                    best.add(scores, batch.column(0), batch.column(1))
            yield from best.batches(ids)

        return run

    def pairs(self, pairs: DataFrame, level: str | None = None) -> DataFrame:
        """query_id, chunk_id, ref_id, score of the chunks of each (query_id, ref_id) pair, where above zero."""
        rows = self.index.forward
        if level:
            rows = rows.where(F.col("level") == level)
        out = self._empty()
        for block, mine in self.blocks(pairs):
            mates = pairs.where(mine).select("query_id", "ref_id").distinct()
            found = rows.join(mates, "ref_id").select("query_id", "chunk_id", "ref_id", "dl", "terms", "tfs")
            out = out.unionByName(found.mapInArrow(self._pair_scorer(block), self._schema()))
        return out

    def _pair_scorer(self, block: Block):
        ids = self._arrow_ids(block.ids)

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            for batch in batches:
                q = pc.index_in(batch.column(0), value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False)
                row, term, part = block.sparse(batch, 3)
                known = q[row] >= 0
                row, term, part = row[known], term[known], part[known]
                scores = np.round(np.bincount(row, part * block.weights[term, q[row]], batch.num_rows), DIGITS)
                out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores)], names=["query_id", "chunk_id", "ref_id", "score"])
                yield out.filter(pa.array(scores > 0))

        return run


def ranked(scores: DataFrame, top_k: int | None, keep_nonpositive: bool = False) -> DataFrame:
    """rank by score, then chunk_id, within a query; scores of zero and less go first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    rows = scores if keep_nonpositive else scores.where("score > 0")
    rows = rows.withColumn("rank", F.row_number().over(w).cast("long"))
    return rows if top_k is None else rows.where(F.col("rank") <= top_k)


def searcher(queries: DataFrame, chunks: DataFrame | Index, config: Config = DEFAULT, tokenizer: Callable[[Column], Column] = keyword_tokens) -> Search:
    """A search over chunks, which are indexed for the queries' terms, or over a stored index."""
    return Search(queries, chunks if isinstance(chunks, Index) else Index.for_queries(queries, chunks, tokenizer), config)


def bm25_topk(queries: DataFrame, chunks: DataFrame | Index, top_k: int, level: str | None = None, allowed: DataFrame | None = None, config: Config = DEFAULT, tokenizer: Callable[[Column], Column] = keyword_tokens) -> DataFrame:
    """query_id, chunk_id, ref_id, score, rank. allowed: (query_id, ref_id) pairs that may be returned; None for all."""
    search = searcher(queries, chunks, config, tokenizer)
    return search.top(top_k, level) if allowed is None else ranked(search.pairs(allowed, level), top_k)
