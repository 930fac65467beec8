"""Exact token counts at every prefix of a text, by dynamic programming over a SentencePiece BPE vocabulary."""

from __future__ import annotations

import functools
import re
from array import array

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, map_rows, sole_cache

SPACE = "▁"
#: Pairs of pieces, chunks, and ends of texts that a worker remembers; a full table is emptied.
CACHE, CHUNKS, ENDS = 400_000, 700_000, 200_000
#: Longer chunks are not remembered.
LONGEST = 64
NONE = float("-inf")


class PieceBpe:
    """Encoding by BPE as the library does it, and the count of tokens at every prefix of a text.

    The encoding of a prefix is the encoding of a shorter prefix and one more piece; that piece is the one whose join with
    the last piece before it the merges would leave apart, and there is just one such piece. So the counts follow from
    left to right. No piece holds a space mark behind another sign; a text thus falls into chunks, runs of space marks
    with what follows up to the next, that are counted one by one.

    From sign to sign goes the tail, the longest end of the prefix that starts some piece: only the pieces that end it are
    tried, and each knows the pieces before it that it was tried with.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.score) or sp.encode("a  b", out_type=str)[0] != SPACE + "a":
            raise ValueError("the vocabulary must mark spaces in front of words and keep them all")
        self.heads = {p[:n] for p in self.score for n in range(len(p) + 1)}
        self.apart: dict[str, dict[str, bool]] = {p: {} for p in self.score}
        self.n_pairs = 0
        self.ends: dict[str, tuple[str, tuple]] = {}
        self.chunks: dict[str, bytes] = {}
        self.totals: dict[str, int] = {}

    def encode(self, chunk: str) -> list[str]:
        """Merge the best-scored neighbours, the leftmost of equal ones, until none can be merged."""
        parts, score = list(chunk), self.score.get
        found = [score(x + y, NONE) for x, y in zip(parts, parts[1:], strict=False)]
        while found:
            best = max(found)
            if best == NONE:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = score(parts[at - 1] + parts[at], NONE)
            if at < len(found):
                found[at] = score(parts[at] + parts[at + 1], NONE)
        return parts

    def _try(self, left: str, piece: str) -> bool:
        """Whether the merges leave the two apart; kept with the piece."""
        if self.n_pairs >= CACHE:
            self._forget_pairs()
        known = self.apart[piece][left] = self.encode(left + piece) == ([left, piece] if left else [piece])
        self.n_pairs += 1
        return known

    def _forget_pairs(self) -> None:
        for known in self.apart.values():
            known.clear()
        self.n_pairs = 0

    def _end(self, text: str) -> tuple[str, tuple]:
        """The tail of a text, and (length, piece, what the piece knows) of each piece that ends it, the longest first."""
        tail = text
        while tail not in self.heads:
            tail = tail[1:]
        if tail != text:
            found = self.ends.get(tail) or self._end(tail)
        else:
            found = tail, tuple((len(p), p, self.apart[p]) for p in (tail[n:] for n in range(len(tail))) if p in self.apart)
        if len(self.ends) >= ENDS:
            self.ends.clear()
        self.ends[text] = found
        return found

    def prefixes(self, chunk: str) -> array:
        """Tokens of chunk[:i] for each i from 0 to its length; a sign outside the vocabulary counts its UTF-8 bytes."""
        counts, last, ends, tail = array("I", [0]), [""], self.ends.get, ""
        for end, sign in enumerate(chunk, 1):
            tail, pieces = ends(tail + sign) or self._end(tail + sign)
            for size, piece, known in pieces:
                left = last[end - size]
                apart = known.get(left)
                if apart is None:
                    apart = self._try(left, piece)
                if apart:
                    counts.append(counts[end - size] + 1)
                    last.append(piece)
                    break
            else:
                if sign in self.score:
                    raise ValueError(f"no piece ends {chunk[:end]!r}")
                counts.append(counts[-1] + len(sign.encode()))
                last.append(sign)
        return counts

    def forget(self) -> None:
        self.totals.clear()
        self.chunks.clear()
        self.ends.clear()
        self._forget_pairs()

    def split(self, text: str) -> list[str]:
        """The chunks of a text, each without its first space mark; the library puts one before the text."""
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return words
        return [x[1:] for x in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))] if text else []

    def table(self, word: str) -> bytes | array:
        """The counts of a chunk; as bytes where it is short, so that they take little room."""
        found = self.chunks.get(word)
        if found is None:
            found = self.prefixes(SPACE + word)
            if len(word) <= LONGEST and found[-1] < 256:
                if len(self.chunks) > CHUNKS:
                    self.chunks.clear()
                found = self.chunks[word] = bytes(found.tolist())
        return found

    def total(self, word: str) -> int:
        """The last count of a chunk, without its table."""
        found = self.prefixes(SPACE + word)[-1]
        if len(word) <= LONGEST:
            if len(self.totals) > CHUNKS:
                self.totals.clear()
            self.totals[word] = found
        return found

    def count(self, text: str) -> int:
        sole_cache("pieces", self.forget)
        known = self.totals.get
        total = 0
        for word in self.split(text):
            total += known(word) or self.total(word)
        return total

    def counts(self, text: str) -> array:
        """Tokens of text[:p] for each p from 0 to its length."""
        out, base = array("I", [0]), 0
        for k, word in enumerate(self.split(text)):
            found = self.table(word)
            out.extend([base + n for n in (found[2:] if k == 0 else found[1:])])
            base += found[-1]
        return out


@functools.cache
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def _counter(path: str, tables: bool):
    def make():
        import pyarrow as pa

        def step(batch):
            coder, texts = piece_bpe(path), batch.column(1).to_pylist()
            cols = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64())]
            if tables:
                found = [coder.counts(t) for t in texts]
                cols += [pa.array([x[-1] for x in found], pa.int64()), pa.array([x.tolist() for x in found], pa.list_(pa.int32()))]
            else:
                cols.append(pa.array([coder.count(t) for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens", "prefix_tokens"][: len(cols)])

        return step

    return make


def prefix_tables(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, prefix_tokens): prefix_tokens[p] is the exact count of tokens of the text's first p code points."""
    return map_rows(keyed_text(docs), _counter(model, True), "doc_id long, n_bytes long, n_tokens long, prefix_tokens array<int>")


def tokens_at(table: Column, chars: Column) -> Column:
    """How many tokens the text cut to so many code points has; all of it when it is shorter."""
    return F.get(table, F.least(F.greatest(chars, F.lit(0)), F.size(table) - 1).cast("int"))


def chars_within(table: Column, budget: Column) -> Column:
    """The longest prefix, in code points, of at most budget tokens. A longer prefix can have fewer tokens, so all are looked at."""
    return F.array_max(F.transform(table, lambda n, p: F.when(n <= budget, p)))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of docs; the count is the last of the prefix counts.

    Null counts as empty, an empty text has no token. Equal rows get equal results; other columns are ignored. The tables
    of chunks are kept for reuse in each worker, those of long chunks and of whole texts only while they are counted.
    """
    rows = map_rows(keyed_text(docs), _counter(model, False), "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
