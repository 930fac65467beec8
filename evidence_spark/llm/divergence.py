"""Source divergence audit: byte tries with counters for each source, merged by prefix range and walked in UTF-8 order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Documents of a language that a term needs; added to each count; what probabilities are scaled by; terms listed for a group.
LEAST_DOCS, PRIOR, SCALE, LISTED = 30, 5, 10**9, 50
#: A task hands on its tries once they hold so many counters, or have read so many bytes.
COUNTERS, READ = 400_000, 128 << 20
#: Bytes of the prefix that names a subtrie; counters in a merged range of them; counters that are merged at a time; counters that
#: a task walks, about: each task hands on a sum for each pair of sources and its candidates.
PREFIX, RANGE, MERGED, WALKED = 3, 20_000, 1_000_000, 250_000
#: Entries of a matrix of sources by terms; sources up to which a task sums pairs before it hands them on.
CELLS, SUMMED = 1_000_000, 1024
#: Bytes at the head of terms that are compared at once.
HEAD = 24
#: Bytes of a long text that are cut into terms at a time.
PIECE = 1 << 20

#: A byte's sign in a term: A-Z count as a-z, all other ASCII signs end a term.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

TRIE = "depth array<int>, tail array<binary>, docs array<long>, sources array<string>, leaf array<int>, source array<int>, n array<long>"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in pieces that end between terms."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_FOLD).split()
        at = end


@dataclass
class Trie:
    """A radix trie as its leaves in byte order, and the counters of each leaf: leaf number, source number and count."""

    terms: list[bytes]
    docs: np.ndarray
    sources: list[str]
    leaf: np.ndarray
    source: np.ndarray
    n: np.ndarray

    def edges(self, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """For each leaf the depth at which its path leaves that of the leaf before, and the bytes below; a subtrie that begins
        at one of starts stands alone."""
        depth, first = np.zeros(len(self.terms), np.int32), np.zeros(len(self.terms), bool)
        first[starts] = True
        for at in range(0, len(self.terms) - 1, 100_000):
            # Terms have no zero byte, so the first byte in which the padded heads differ is where the paths part.
            heads = np.array(self.terms[at : at + 100_001], f"S{HEAD}").view(np.uint8).reshape(-1, HEAD)
            differ = heads[1:] != heads[:-1]
            here = differ.argmax(axis=1)
            for i in np.flatnonzero(~differ.any(axis=1)).tolist():
                x, y = self.terms[at + i], self.terms[at + i + 1]
                n = min(len(x), len(y))
                here[i] = n if x[:n] == y[:n] else next(k for k in range(HEAD, n) if x[k] != y[k])
            depth[at + 1 : at + 1 + len(here)] = here
        depth[first] = 0
        return depth, [t[d:] for t, d in zip(self.terms, depth.tolist(), strict=True)]

    def kept(self, least: int) -> Trie:
        """The leaves that at least so many documents hold."""
        keep = self.docs >= least
        number = np.cumsum(keep) - 1
        own = keep[self.leaf]
        return Trie([t for t, k in zip(self.terms, keep.tolist(), strict=True) if k], self.docs[keep], self.sources, number[self.leaf[own]], self.source[own], self.n[own])


def _spelled(depth: list[int], tail: list[bytes]) -> list[bytes]:
    terms, last = [], b""
    for d, t in zip(depth, tail, strict=True):
        last = last[:d] + t
        terms.append(last)
    return terms


def trie_of(row: dict) -> Trie:
    docs, leaf, source, n = (np.asarray(row[c], np.int64) for c in ("docs", "leaf", "source", "n"))
    return Trie(_spelled(row["depth"], row["tail"]), docs, list(row["sources"]), leaf, source, n)


def _joined(rows) -> Trie:
    """The subtries of a record batch's rows side by side, as one list of leaves: a term may come several times."""
    lists = {c: rows.column(c) for c in ("depth", "tail", "docs", "sources", "leaf", "source", "n")}
    flat = {c: x.flatten() for c, x in lists.items()}
    sizes = {c: lists[c].value_lengths().to_numpy(zero_copy_only=False) for c in ("depth", "sources", "leaf")}
    before = {c: np.repeat(np.cumsum(x) - x, sizes["leaf"]) for c, x in sizes.items() if c != "leaf"}
    names = flat["sources"].dictionary_encode()
    number = lambda c: flat[c].to_numpy(zero_copy_only=False).astype(np.int64)
    source = names.indices.to_numpy(zero_copy_only=False)[number("source") + before["sources"]]
    return Trie(_spelled(flat["depth"].to_pylist(), flat["tail"].to_pylist()), number("docs"), names.dictionary.to_pylist(), number("leaf") + before["depth"], source.astype(np.int64), number("n"))


def merge(tries: list[Trie]) -> Trie:
    """One trie with the sums of all counters."""
    terms = sorted({t for x in tries for t in x.terms})
    at = {t: i for i, t in enumerate(terms)}
    names = sorted({s for x in tries for s in x.sources})
    number = {s: i for i, s in enumerate(names)}
    own = [np.fromiter(map(at.__getitem__, x.terms), np.int64, len(x.terms)) for x in tries]
    docs = np.zeros(len(terms), np.int64)
    for o, x in zip(own, tries, strict=True):
        np.add.at(docs, o, x.docs)
    key = np.concatenate([o[x.leaf] * len(names) + np.array([number[s] for s in x.sources], np.int64)[x.source] for o, x in zip(own, tries, strict=True) if len(x.leaf)] or [np.empty(0, np.int64)])
    n = np.concatenate([x.n for x in tries] or [np.empty(0, np.int64)])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    sums = np.add.reduceat(n, head) if len(head) else n
    return Trie(terms, docs, names, key[head] // max(1, len(names)), key[head] % max(1, len(names)), sums)


def _lists(values, offsets, kind):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _subtries(lang: str, trie: Trie, starts: np.ndarray):
    """A record batch with one row for each subtrie: the leaves from one of starts up to the next. Source numbers are the row's own."""
    import pyarrow as pa

    bounds = np.append(starts, len(trie.terms))
    depth, tail = trie.edges(starts)
    row = np.searchsorted(starts, trie.leaf, "right") - 1  # counters are in the order of their leaves
    cuts = np.searchsorted(trie.leaf, bounds)
    width = max(1, len(trie.sources))
    used, local = np.unique(row * width + trie.source, return_inverse=True)
    first = np.searchsorted(used, np.arange(len(starts) + 1) * width)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * len(starts), pa.string()), pa.array([trie.terms[i][:PREFIX] for i in starts.tolist()], pa.binary()), _lists(depth, bounds, pa.int32()), _lists(tail, bounds, pa.binary()), _lists(trie.docs, bounds, pa.int64()),
            _lists([trie.sources[i] for i in (used % width).tolist()], first, pa.string()), _lists((trie.leaf - starts[row]).astype(np.int32), cuts, pa.int32()), _lists((local - first[row]).astype(np.int32), cuts, pa.int32()), _lists(trie.n, cuts, pa.int64()),
        ],
        names=["lang", "prefix", "depth", "tail", "docs", "sources", "leaf", "source", "n"],
    )


def _handed_on(groups: dict[tuple[str, str], Counter], docs: dict[str, Counter]):
    """The tries of a task's counts, one row for each language and prefix."""
    for lang, holders in docs.items():
        if not holders:
            continue
        terms = sorted(holders)
        at = {t: i for i, t in enumerate(terms)}
        own = [(source, c) for (l, source), c in groups.items() if l == lang]
        leaf = np.concatenate([np.fromiter(map(at.__getitem__, c), np.int64, len(c)) for _, c in own])
        source = np.repeat(np.arange(len(own)), [len(c) for _, c in own])
        n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in own])
        order = np.lexsort((source, leaf))
        trie = Trie(terms, np.fromiter(map(holders.__getitem__, terms), np.int64, len(terms)), [s for s, _ in own], leaf[order], source[order], n[order])
        starts = np.array([i for i, t in enumerate(terms) if i == 0 or t[:PREFIX] != terms[i - 1][:PREFIX]], np.int64)
        yield _subtries(lang, trie, starts)


def _count(batches: Iterator) -> Iterator:
    import pyarrow as pa

    groups, docs, held, read = {}, {}, 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                own, seen = groups.setdefault((lang, source), Counter()), set()
                before = len(own)
                for words in terms_of(text):
                    own.update(words)
                    seen.update(words)
                docs.setdefault(lang, Counter()).update(seen)
                held, read = held + len(own) - before, read + len(text)
                if held >= COUNTERS or read >= READ:
                    yield from _handed_on(groups, docs)
                    groups, docs, held, read = {}, {}, 0, 0
    yield from _handed_on(groups, docs)


def _merge_ranges(least: int):
    """Rows sorted by (lang, prefix): the subtries of consecutive prefixes of a language become one range of about RANGE counters."""

    def run(batches: Iterator) -> Iterator:
        lang, parts, fresh, size = None, [], 0, 0

        def done():
            whole = merge(parts).kept(least)
            if whole.terms:
                yield _subtries(lang, whole, np.zeros(1, np.int64))

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                langs, prefixes, held = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(8).value_lengths().to_pylist()
                start, key = 0, (langs[0], prefixes[0])
                if parts and (langs[0] != lang or size >= RANGE and prefixes[0] != last):
                    yield from done()
                    parts, fresh, size = [], 0, 0
                lang = langs[0]
                for i in range(batch.num_rows):
                    if (langs[i], prefixes[i]) != key:
                        key = (langs[i], prefixes[i])
                        if langs[i] != lang or size >= RANGE:
                            parts.append(_joined(batch.slice(start, i - start)))
                            yield from done()
                            start, lang, parts, fresh, size = i, langs[i], [], 0, 0
                    fresh, size = fresh + held[i], size + held[i]
                parts.append(_joined(batch.slice(start)))
                last = prefixes[-1]
                if fresh >= MERGED:
                    parts, fresh = [merge(parts)], 0
        if parts:
            yield from done()

    return run


def term_tries(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, prefix, depth, tail, docs, sources, leaf, source, n): the terms of each language that at least so many of its rows
    hold, in tries by range of prefixes, with a counter for each source that has the term.

    A task counts the terms of its rows in byte tries, one for each language, with a counter for each source in the leaves; it
    cuts them into subtries by the first PREFIX bytes and hands them on. Only these are shuffled, so a term, text or source with
    any number of rows weighs once for each task. Tries with the same prefix meet in one task, which adds them up; sums are
    made whenever MERGED counters are held.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text.alias("text"))
    kind = f"lang string, prefix binary, {TRIE}"
    return rows.mapInArrow(_count, kind).repartition("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInArrow(_merge_ranges(least_docs), kind)


def probabilities(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), in integers: three digits of a thousand each, as the product may pass 64 bits.
    Exact for totals up to 9 * 10**15."""
    rest, out = counts + PRIOR, np.zeros(np.broadcast_shapes(counts.shape, total.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _best(held: list[tuple[int, bytes]], values: np.ndarray, terms: list[bytes], listed: int) -> list[tuple[int, bytes]]:
    """The first of held and the new candidates by value, highest first, then by term."""
    at = np.flatnonzero(values > 0)
    if len(at) > listed:
        at = at[values[at] >= np.partition(values[at], len(at) - listed)[len(at) - listed]]
    return sorted(held + [(int(values[i]), terms[i]) for i in at.tolist()], key=lambda x: (-x[0], x[1]))[:listed]


def _walk(listed: int):
    """Rows (lang, names, totals, v, trie): sums of differences for pairs of sources, and candidates for the terms of each."""
    import pyarrow as pa

    def batch(rows: list[tuple[str, str, str, str, int]]):
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.string()] * 4 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "source", "part", "item", "value"])

    def pairs(lang: str, names: list[str], i: int, sums: np.ndarray):
        return batch([(lang, names[i], "pair", t, int(x)) for t, x in zip(names[i + 1 :], sums.tolist(), strict=True)])

    def told(lang: str, names: list[str], sums, best: list[list[tuple[int, bytes]]]):
        for i in range(len(names)) if sums is not None else ():
            yield pairs(lang, names, i, sums[i, i + 1 :])
        yield batch([(lang, s, "term", t.decode("utf-8", "replace"), f) for s, held in zip(names, best, strict=True) for f, t in held])

    def run(batches: Iterator) -> Iterator:
        lang, names, sums, best = None, [], None, []
        for rows in batches:
            for at in range(rows.num_rows):
                row = rows.slice(at, 1).to_pylist()[0]
                if row["lang"] != lang:
                    if lang is not None:
                        yield from told(lang, names, sums, best)
                    lang, names = row["lang"], row["names"]
                    sums = np.zeros((len(names), len(names)), np.int64) if len(names) <= SUMMED else None
                    best = [[] for _ in names]
                    number = {s: i for i, s in enumerate(names)}
                    whole = (np.array(row["totals"], np.int64) + PRIOR * row["v"])[:, None]
                    if sums is None:  # every pair of the language gets a row, also where there is no term
                        for i in range(len(names)):
                            yield pairs(lang, names, i, np.zeros(len(names) - i - 1, np.int64))
                trie = trie_of(row)
                own = np.array([number[s] for s in trie.sources], np.int64)
                all_ = np.array([sum(row["totals"]) + PRIOR * row["v"]])
                step = max(1, CELLS // max(1, len(names)))
                for a in range(0, len(trie.terms), step):
                    b = min(a + step, len(trie.terms))
                    i, j = np.searchsorted(trie.leaf, (a, b))
                    counts = np.zeros((len(names), b - a), np.int64)
                    counts[own[trie.source[i:j]], trie.leaf[i:j] - a] = trie.n[i:j]
                    p, q = probabilities(counts, whole), probabilities(counts.sum(axis=0), all_)
                    above = np.where(counts > 0, p - q, 0)
                    for s in range(len(names)):
                        best[s] = _best(best[s], above[s], trie.terms[a:b], listed)
                        apart = np.abs(p[s + 1 :] - p[s]).sum(axis=1)
                        if sums is not None:
                            sums[s, s + 1 :] += apart
                        else:
                            yield pairs(lang, names, s, apart)
        if lang is not None:
            yield from told(lang, names, sums, best)

    return run


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, listed: int = LISTED) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are apart, and the terms that stand out in each.

    Part `pair`: for each other source of the language, the sum over the language's kept terms of the difference of both
    smoothed probabilities. Part `term`: the terms that the group has and that are likelier in it than in its language, up to
    `listed` of them. Ranks go by value, highest first, then by the UTF-8 bytes of the item. All arithmetic is in integers.

    Null texts, languages and sources are empty ones. Rows that repeat a doc_id are documents of their own; doc_id and other
    columns are not read. A group without any term has the prior's probability everywhere; where a language keeps no term, its
    pairs have value 0. A source alone in its language has no pair. An empty table gives an empty result.

    What travels by language is one row with its sources and their sums; the result itself has a row for each pair of them.
    """
    tries = materialize(term_tries(docs, least_docs), "tries")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    counted = tries.select("lang", F.explode(F.zip_with("source", "n", lambda s, n: F.struct(s.alias("k"), n.alias("n")))).alias("x"), "sources").groupBy("lang", F.get("sources", F.col("x.k")).alias("source")).agg(F.sum("x.n").alias("total"))
    sums = groups.join(counted, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("g"))
    sizes = tries.groupBy("lang").agg(F.sum(F.size("tail")).alias("v"))
    sums = materialize(sums.join(sizes, "lang", "left").select("lang", F.col("g.source").alias("names"), F.col("g.total").alias("totals"), F.coalesce("v", F.lit(0)).alias("v")), "sums")
    none = [F.array().cast(k).alias(c) for c, k in (x.split() for x in TRIE.split(", "))]
    columns = ["lang", "names", "totals", "v", *(x.split()[0] for x in TRIE.split(", "))]
    tasks = 1 + (tries.agg(F.sum(F.size("n"))).first()[0] or 0) // WALKED
    walked = tries.join(sums, "lang").select(columns).unionByName(sums.select("lang", "names", "totals", "v", *none))
    found = materialize(walked.coalesce(tasks).sortWithinPartitions("lang").mapInArrow(_walk(listed), "lang string, source string, part string, item string, value long"), "walked")
    whole = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = whole.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(w))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= listed))
