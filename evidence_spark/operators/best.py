"""The k best rows of each query within a task, in bounded space: shared by the block searches."""

from __future__ import annotations

#: Columns that come out of a task's search, before the final rank.
FOUND = "chunk_id string, ref_id string, score double"


class Best:
    """Takes scored rows batch by batch and keeps, for each query number, the k best by (score down, chunk_id up)."""

    def __init__(self, queries: int, k: int):
        import numpy as np

        self.k, self.room = k, max(50_000, 2 * queries * k)
        self.floor = np.full(queries, -np.inf)
        self.held: list = []
        self.rows = 0

    def add(self, scores, chunk_ids, ref_ids) -> None:
        """scores: rows x queries, -inf for rows that don't count; ids are Arrow arrays with one value for each row."""
        import numpy as np
        import pyarrow as pa

        m = min(self.k, len(scores))
        if not m:
            return
        cut = np.maximum(np.partition(scores, len(scores) - m, axis=0)[len(scores) - m], self.floor)
        row, q = np.nonzero((scores >= cut) & (scores > -np.inf))
        if len(row) > 2 * m * scores.shape[1]:  # many ties at the cut: those of the smallest ids will do
            place = np.empty(len(scores), np.int64)
            place[np.asarray(chunk_ids.to_pandas()).argsort(kind="stable")] = np.arange(len(scores))
            o = np.lexsort((place[row], -scores[row, q], q))
            row, q = row[o], q[o]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            row, q = row[nth < self.k], q[nth < self.k]
        at = pa.array(row)
        self.held.append(pa.table({"q": pa.array(q, pa.int64()), "score": pa.array(scores[row, q], pa.float64()), "chunk_id": chunk_ids.take(at), "ref_id": ref_ids.take(at)}))
        self.rows += len(row)
        if self.rows > self.room:
            self.held = [self.top()]
            self.rows = len(self.held[0])

    def top(self):
        import numpy as np
        import pyarrow as pa

        if not self.held:
            return None
        t = pa.concat_tables(self.held).combine_chunks().sort_by([("q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
        q = t["q"].to_numpy()
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        t = t.filter(pa.array(nth < self.k))
        last = t.filter(pa.array(nth[nth < self.k] == self.k - 1))
        self.floor[last["q"].to_numpy()] = last["score"].to_numpy()
        return t

    def batches(self, ids):
        """What is left at the end of a task, with the queries' own ids (an Arrow array)."""
        import pyarrow as pa

        t = self.top()
        if t is not None and len(t):
            t = t.combine_chunks()
            for b in t.to_batches(max_chunksize=10_000):
                yield pa.RecordBatch.from_arrays([ids.take(b.column("q")), b.column("chunk_id"), b.column("ref_id"), b.column("score")], names=["query_id", "chunk_id", "ref_id", "score"])
