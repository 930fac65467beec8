"""Bounded-space online packing of token sequences into windows of a fixed size."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed_text, materialize

#: Tokens in a window.
WINDOW = 2048
#: Windows that a task holds open.
OPEN = 16
#: Tasks whose leftovers one task of the next round merges.
MERGE = 16

PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, left boolean, task long"


class Packer:
    """Holds at most `open_` windows; a window is a list of pieces and its fill. Ids are bytes, 4 for each."""

    def __init__(self, window: int, open_: int):
        self.window, self.limit, self.open, self.full = window, open_, [], []

    def add(self, doc_id: int, start: int, ids: bytes, total: int) -> None:
        """Whole windows are cut off first. The rest goes where it leaves the least room. If it fits nowhere and no more
        windows may be opened, the fullest is topped up with its head and emitted; what remains is placed in turn."""
        n = len(ids) // 4
        while n >= self.window:
            self.full.append([(doc_id, start, ids[: 4 * self.window], total)])
            start, ids, n = start + self.window, ids[4 * self.window :], n - self.window
        while n:
            fits = [w for w in self.open if w[0] + n <= self.window]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.limit:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
            part = min(n, self.window - best[0])
            best[0] += part
            best[1].append((doc_id, start, ids[: 4 * part], total))
            start, ids, n = start + part, ids[4 * part :], n - part
            if best[0] == self.window:
                self.open.remove(best)
                self.full.append(best[1])

    def drain(self) -> list[list[tuple]]:
        out, self.full = self.full, []
        return out


def powers_of_two(pieces: list[tuple], window: int) -> list[list[tuple]]:
    """Cut the pieces, in order, into sequences whose lengths are the powers of two in the sum of their lengths: none needs padding."""
    left, out = sum(len(p[2]) // 4 for p in pieces), []
    rest = list(pieces)
    while left:
        size = min(window, 1 << left.bit_length() - 1)
        left -= size
        sequence = []
        while size:
            doc_id, start, ids, total = rest.pop(0)
            part = min(size, len(ids) // 4)
            sequence.append((doc_id, start, ids[: 4 * part], total))
            if 4 * part < len(ids):
                rest.insert(0, (doc_id, start + part, ids[4 * part :], total))
            size -= part
        out.append(sequence)
    return out


def _rows(sequences: list[tuple[list[tuple], int]], left: bool, task: int, keep_ids: bool):
    import zlib

    import pyarrow as pa

    cols: list[list] = [[] for _ in range(10)]
    for pieces, number in sequences:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            for col, value in zip(cols, (doc_id, start, n, ids if left or keep_ids else None, zlib.crc32(ids), total, number, offset, left, task), strict=True):
                col.append(value)
            offset += n
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4 + [pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def _pack(entries, level: int, last: bool, window: int, open_: int, keep_ids: bool) -> Iterator:
    """Pack (doc_id, start, ids, total) entries of one task. Sequence numbers hold the round, the task and a count."""
    from pyspark import TaskContext

    task, count = TaskContext.get().partitionId(), 0
    packer = Packer(window, open_)

    def numbered(windows):
        nonlocal count
        out = [(w, level << 58 | task << 34 | count + k) for k, w in enumerate(windows)]
        count += len(windows)
        return out

    for entry in entries:
        packer.add(*entry)
        if len(packer.full) >= 256:
            yield _rows(numbered(packer.drain()), False, task, keep_ids)
    yield _rows(numbered(packer.drain()), False, task, keep_ids)
    rest = [w[1] for w in packer.open]
    if last:
        yield _rows(numbered(powers_of_two([p for w in rest for p in w], window)), False, task, keep_ids)
    else:
        yield _rows([(w, -1) for w in rest], True, task, keep_ids)


def _first_round(path: str, end: int, window: int, open_: int, keep_ids: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        from .common import word_bpe

        coder, tail = word_bpe(path), np.array([end], "<u4").tobytes()

        def entries():
            for batch in batches:
                ids = coder.encode(batch.column(1).to_pylist())
                for doc_id, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                    yield doc_id, 0, x + tail, len(x) // 4 + 1

        return _pack(entries(), 0, False, window, open_, keep_ids)

    return run


def _merge_round(level: int, last: bool, window: int, open_: int, keep_ids: bool):
    def run(batches: Iterator) -> Iterator:
        def entries():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)

        return _pack(entries(), level, last, window, open_, keep_ids)

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 1, window: int = WINDOW, open_windows: int = OPEN, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece of a document.

    Each task packs its rows as they come, with a fixed number of open windows (see Packer). The windows that it leaves
    open go to a task of the next round, as many as open_windows from each of MERGE tasks, until one task is left; that
    one cuts its remainder into powers of two. So no sequence needs padding, no task holds more than open_windows windows
    besides a batch, and each round shuffles a fixed amount for each task of the round before.

    A document is its ids and then the end id, so empty and null texts make a piece of one id. Rows that repeat a doc_id
    are packed as rows of their own. An empty table gives an empty result. keep_ids adds the column ids (little-endian
    32-bit). Sequence ids are unique but not consecutive.
    """
    rows = materialize(keyed_text(docs).mapInArrow(_first_round(tokenizer, end, window, open_windows, keep_ids), PIECES), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    done, left, level = rows.where("not left").select(columns), rows.where("left"), 1
    tasks = left.agg(F.max("task")).first()[0]
    while tasks is not None:
        groups = tasks // MERGE + 1
        entries = left.select(F.floor(F.col("task") / MERGE).alias("group"), "doc_id", "start", "ids", "doc_tokens")
        entries = entries.repartitionByRange(groups, "group") if groups > 1 else entries.coalesce(1)
        entries = entries.sortWithinPartitions("group", "doc_id", "start").select("doc_id", "start", "ids", "doc_tokens")
        rows = materialize(entries.mapInArrow(_merge_round(level, groups == 1, window, open_windows, keep_ids), PIECES), "pieces")
        done = done.unionByName(rows.where("not left").select(columns))
        if groups == 1:
            break
        left, level = rows.where("left"), level + 1
        tasks = left.agg(F.max("task")).first()[0]
    return done
