"""Counts over groups of rows, in total and up to a value, without comparing rows with each other.

A step counts, for each row, the rows with the same keys that have a weight: all of them, or those up to the row's own value. Two
ways give the same. in_tasks() sorts whole groups within tasks, after one shuffle. spread() is for groups that no task should
hold: totals are aggregated and joined, running counts go over ranges of values, so that a group of any size takes as many tasks
as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..tables import written

#: Rows that a task sorts at a time, at least; whole groups always. A task's memory follows from it, not from the size of its input.
ROWS = 20_000


@dataclass(frozen=True)
class Step:
    """counts: name of a count -> column with 0 or 1. value: the column up to which rows count, None for all rows. first: the
    column of 0 or 1 whose rows count before others of equal value where it is ahead, after them where it is not."""

    keys: tuple[str, ...]
    counts: dict[str, str] = field(hash=False)
    value: str | None = None
    first: str | None = None
    ahead: bool = True


def in_tasks(rows: DataFrame, by: list[str], steps: tuple[Step, ...], keep: list[str], only: str) -> DataFrame:
    """keep and the counts of all steps, for rows where `only` is 0. Every step counts within equal `by`."""
    schema = StructType([f for f in rows.schema.fields if f.name in keep] + [StructField(name, LongType()) for s in steps for name in s.counts])
    keep = [f.name for f in schema.fields if f.name in keep]

    def counted(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        codes: dict[str, np.ndarray] = {}

        def code(name: str) -> np.ndarray:
            if name not in codes:
                codes[name] = table.column(name).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            return codes[name]

        def number(keys: tuple[str, ...]) -> np.ndarray:
            if keys not in numbers:
                before, last = number(keys[:-1]), code(keys[-1])
                numbers[keys] = np.unique(before * (int(last.max()) + 1) + last, return_inverse=True)[1]
            return numbers[keys]

        numbers: dict[tuple[str, ...], np.ndarray] = {}
        whole = np.zeros(table.num_rows, np.int64)
        for b in by:
            whole = np.unique(whole * (int(code(b).max()) + 1) + code(b), return_inverse=True)[1]
        numbers[()] = whole
        wanted = np.flatnonzero(table.column(only).to_numpy() == 0)
        out = {c: table.column(c).take(pa.array(wanted)).combine_chunks() for c in keep}
        for s in steps:
            key = number(s.keys)
            order = None
            if s.value is not None:
                x = pc.fill_null(table.column(s.value), 0.0).to_numpy()
                tie = table.column(s.first).to_numpy()
                order = np.lexsort((-tie if s.ahead else tie, x, key))
                at = key[order]
                start = np.searchsorted(at, at)
            for name, weight in s.counts.items():
                w = table.column(weight).to_numpy().astype(np.int64)
                if order is None:
                    got = np.bincount(key, w).astype(np.int64)[key]
                else:
                    run = np.concatenate(([0], np.cumsum(w[order])))
                    got = np.empty(len(key), np.int64)
                    got[order] = run[1:] - run[start]
                out[name] = pa.array(got[wanted])
        return pa.RecordBatch.from_arrays([out[f.name] for f in schema.fields], names=[f.name for f in schema.fields])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            differs = np.zeros(size - 1, bool)
            for b in by:
                c = table.column(b).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                differs |= c[1:] != c[:-1]
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if cut:
                yield counted(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            size -= cut
        if size:
            yield counted(pa.Table.from_batches(held))

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _same(keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return on


def spread(rows: DataFrame, by: list[str], steps: tuple[Step, ...], keep: list[str], only: str) -> DataFrame:
    """The same for groups of any size. A step with a value writes its rows once, as its parts read them twice."""
    for s in steps:
        keys = [*by, *s.keys]
        if s.value is None:
            sums = rows.groupBy(*keys).agg(*(F.sum(F.col(w).cast("long")).alias(n) for n, w in s.counts.items()))
            rows = rows.alias("a").join(sums.alias("b"), _same(keys)).select("a.*", *(f"b.{n}" for n in s.counts))
            continue
        value, tie = F.coalesce(s.value, F.lit(0.0)), F.col(s.first).desc() if s.ahead else F.col(s.first).asc()
        order = [*map(F.col, keys), value, tie]
        ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranged")
        parts = ranged.groupBy("_p", *keys).agg(*(F.sum(F.col(w).cast("long")).alias(n) for n, w in s.counts.items()))
        w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that has some of the group
        parts = parts.select("_p", *keys, *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_{n}") for n in s.counts))
        own = Window.partitionBy("_p", *keys).orderBy(value, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = ranged.select("*", *(F.sum(F.col(w_).cast("long")).over(own).alias(n) for n, w_ in s.counts.items()))
        joined = local.alias("a").join(parts.alias("b"), _same(["_p", *keys]))
        rows = joined.select(*(F.col(f"a.{c}") for c in rows.columns), *((F.col(f"a.{n}") + F.col(f"b._{n}")).alias(n) for n in s.counts))
    names = [n for s in steps for n in s.counts]
    return rows.where(F.col(only) == 0).select(*(f.name for f in rows.schema.fields if f.name in keep), *names)
