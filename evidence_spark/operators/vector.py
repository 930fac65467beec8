"""Exact inner-product search: blocks of vectors times a block of queries, and a top-k from each task."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.vectors import inner_product
from .best import FOUND, Best
from .bm25 import ranked

#: Queries in one pass over the vectors; more are answered in further passes. Scores that a task holds at a time.
PASS, CELLS = 4096, 1_000_000
#: Decimal digits of a score; ranks are taken on rounded scores, so that ties are ties in every order of summation.
DIGITS = 6


def _search(ids, matrix, labels, k: int):
    """ids and labels are Arrow arrays, labels None where they do not count."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow.compute as pc

        if not len(ids):
            return
        best, step = Best(len(ids), k), max(16, CELLS // len(ids))
        codes = None
        if labels is not None:
            kinds = pc.unique(labels)
            codes = pc.index_in(labels, value_set=kinds).to_numpy(zero_copy_only=False)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                scores = np.round(x @ matrix.T, DIGITS)
                if codes is not None:
                    own = pc.index_in(batch.column(3).cast(labels.type), value_set=kinds).fill_null(-1).to_numpy(zero_copy_only=False)
                    scores[own[:, None] != codes[None, :]] = -np.inf
                best.add(scores, batch.column(0), batch.column(1))
        yield from best.batches(ids)

    return run


def vector_candidates(queries: DataFrame, vectors: DataFrame, k: int, same_label: bool = False) -> DataFrame:
    """query_id, chunk_id, ref_id, score: for each query the k best vectors of each task.

    A stated set of queries against all vectors, in blocks: PASS queries of d values at a time are sent to the tasks.
    same_label keeps vectors with the query's label only, before the cut, so sparse labels are found as well. Query ids may be
    of any type. Null vectors have no score.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = queries.schema["query_id"].dataType
    schema = StructType([StructField("query_id", kind), *StructType.fromDDL(FOUND)])
    asked = queries.where("embedding is not null")
    total, out = asked.count(), None
    passes = max(1, -(-total // PASS))
    for p in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
        rows = part.select("query_id", "embedding", *(["label"] if same_label else [])).collect()  # about PASS rows
        matrix = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)
        columns = ["chunk_id", "ref_id", "embedding", *(["label"] if same_label else [])]
        labels = pa.array([r[2] for r in rows], to_arrow_type(queries.schema["label"].dataType)) if same_label else None
        found = vectors.where("embedding is not null").select(columns).mapInArrow(_search(pa.array([r[0] for r in rows], to_arrow_type(kind)), matrix, labels, k), schema)
        out = found if out is None else out.unionByName(found)
    return out


def score_pairs(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, chunk_id, ref_id, score of the vectors of each (query_id, ref_id) pair: for restricted searches."""
    q = queries.select("query_id", F.col("embedding").alias("_q"))
    d = vectors.select("chunk_id", "ref_id", "embedding").join(pairs.select("query_id", "ref_id").distinct(), "ref_id").join(q, "query_id")
    return d.select("query_id", "chunk_id", "ref_id", F.round(inner_product(F.col("_q"), F.col("embedding")), DIGITS).alias("score"))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, same_label: bool = False) -> DataFrame:
    return ranked(vector_candidates(queries, vectors, k, same_label), k, True)
