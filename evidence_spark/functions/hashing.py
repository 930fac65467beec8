"""Content hashes. The canonical form is our own; equality, not the digest, is what carries meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_hash(*columns: Column, length: int = 64) -> Column:
    """SHA-256 of the columns as text, each preceded by its length, null told apart from empty."""
    return F.substring(F.sha2(packed(*columns), 256), 1, length)


def set_hash(items: Column) -> Column:
    """An aggregate: the hash of a group's hex digests, whatever their order, repeats counted.

    Four pieces of 60 bits of each digest are summed without overflow, so that the sums combine within each task and no
    group is ever gathered in one place; the hash is that of the count and the sums.
    """
    piece = lambda k: F.coalesce(F.sum(F.conv(F.substring(F.sha2(items, 256), 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").cast("string")
    return F.sha2(F.concat_ws(",", F.count(items).cast("string"), *(piece(k) for k in range(4))), 256)


def packed(*columns: Column) -> Column:
    """The columns as one text that tells any two rows apart: each preceded by its length, null told apart from empty."""
    return F.concat_ws(",", *(F.coalesce(F.concat(F.char_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns))


def conditions_text(conditions: Column) -> Column:
    """Conditions sorted by class, value and unit; a missing unit counts as empty."""
    one = F.transform(conditions, lambda c: packed(c["eddo_class"], c["value"], F.coalesce(c["unit"], F.lit(""))))
    return F.array_join(F.array_sort(F.coalesce(one, F.array())), ";")
