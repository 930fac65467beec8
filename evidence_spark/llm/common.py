"""What the operators share: the shared folder, written intermediate tables, schema guards and chunked tokenizing."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..tables import discard, new_path, shared_dir  # noqa: F401  for the operators

#: Parts of words kept in a worker's cache of ids; as many again are kept of the ones before.
CACHE_WORDS = 300_000
#: Rows that a worker's function gets at a time.
ROWS = 2500
#: Signs of text, about, whose words are told apart at a time.
SIGNS = 4 << 20


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)  # a task's buffers stay small
    out = spark.read.schema(StructType.fromJson(df.schema.jsonValue())).parquet(path)
    out._stored_at = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def keyed_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, null as empty: other columns, clashing names included, never reach an operator."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: StructType | DataType | str) -> DataFrame:
    """mapInArrow where make() builds the per-worker function batch -> batch iterator; equal inputs give equal outputs, so lost tasks can run again."""

    def run(batches: Iterator) -> Iterator:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield from step(batch.slice(at, ROWS))

    return df.mapInArrow(run, schema)


_caches: dict[str, Callable[[], None]] = {}


def sole_cache(owner: str, clear: Callable[[], None]) -> None:
    """A worker process serves the tasks of many stages; it keeps the cache in use, one owner's own, drops all others and gives
    their memory back."""
    if _caches.get(owner) != clear:
        former = list(_caches.values())
        _caches.clear()
        _caches[owner] = clear
        for other in former:
            other()
        if former:
            release()


def release() -> None:
    """Hand memory that is free, but held by the allocators, back to the system where they can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class _Parts(dict):
    """Ids of parts, in two generations: when the young one is full it becomes the old one, and what is still used moves up."""

    def __init__(self, tokenize, dtype: str):
        self.tokenize, self.dtype, self.old = tokenize, dtype, {}
        # The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.alphabet = [chr(b) if b in plain else chr(next(others)) for b in range(256)]

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            signs = part if part.isascii() else "".join(map(self.alphabet.__getitem__, part.encode()))
            ids = array(self.dtype, [t.id for t in self.tokenize(signs)]).tobytes()
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[part] = ids
        return ids


class WordBpe:
    """Ids of whole texts by a word-level BPE tokenizer file of the tokenizers library.

    The file's pattern parts a text into contractions, runs of letters, single digits and runs of other signs; white space
    is dropped and no id crosses a part. For texts of ASCII and precomposed Latin letters, where normalising means lower
    case alone, white space parts the words of many texts at once in Arrow, and the same pattern parts each distinct word
    once; the library's model encodes each part, once while it stays in a bounded cache. Texts with any other sign, or with
    what looks like a special token, are encoded by the library as a whole.
    """

    LETTERS = "a-zß-öø-ÿ"
    PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*").fullmatch
    PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9\t-\r ]+").findall

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.parts = _Parts(self.tokenizer.model.tokenize, "I")

    def forget(self) -> None:
        self.parts.clear()
        self.parts.old.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text the ids as little-endian unsigned 32-bit integers; null and empty texts give none."""
        sole_cache("words", self.forget)
        out, plain, rest, signs = [b""] * len(texts), [], [], 0
        for i, t in enumerate(texts):
            if t and (not self.PLAIN(t) or "<|" in t):
                rest.append(i)
            elif t:
                plain.append(i)
                signs += len(t)
                if signs >= SIGNS:
                    self._by_words(texts, plain, out)
                    plain, signs = [], 0
        if plain:
            self._by_words(texts, plain, out)
        for k in range(0, len(rest), 100):
            part = rest[k : k + 100]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = array("I", e.ids).tobytes()
        return out

    def _by_words(self, texts: list[str | None], at: list[int], out: list[bytes]) -> None:
        """Sets out[i] for each i of at: every distinct word is looked up once, and its ids are put where it occurs."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # Space and the controls 9 to 13 are all the white space of a plain text. A text that begins or ends with it has empty words there.
        words = pc.ascii_split_whitespace(pa.array([texts[i].lower() for i in at], pa.large_string()))
        coded = words.values.dictionary_encode()
        known, find = self.parts.__getitem__, self.PARTS
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array([known(w) if w.isalpha() else b"".join(map(known, find(w))) for w in distinct], pa.large_binary())
        ids = ids.take(coded.indices)
        ends, data = np.frombuffer(ids.buffers()[1], np.int64), memoryview(ids.buffers()[2] or b"")
        ends = ends[words.offsets.to_numpy()].tolist()
        for i, a, b in zip(at, ends, ends[1:], strict=False):
            out[i] = bytes(data[a:b])


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """One tokenizer and one cache for each worker process, whatever the number of its tasks."""
    return WordBpe(path)
