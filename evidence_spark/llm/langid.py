"""Language identification: script ranges narrow the candidates, Viterbi over the scores of words' pieces labels spans."""

from __future__ import annotations

import functools
import math
import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, map_rows, sole_cache

#: First code point of each range and its script; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF66, "Kana"), (0xFFA0, "Other"), (0x20000, "Han"), (0x33480, "Other"),
]
#: Labelled rows that are read to fit a model, on average; they are drawn by a hash of doc_id.
SAMPLE = 20_000
#: Hashed features of a language.
FEATURES = 1 << 16
#: Cost in nats of a change of language between two pieces.
SWITCH = 12.0
#: What a piece scores in a language that does not use its script: more than the two changes that go round it.
EXCLUDED = 50.0
#: Words whose scores a worker keeps, and words that are scored at a time.
WORDS, SLICE = 150_000, 100_000
#: Signs in a piece of a word, at most.
PIECE = 40
UNKNOWN = "und"


@functools.lru_cache(1 << 14)
def script_of(char: str) -> str:
    import bisect

    return SCRIPTS[bisect.bisect_right(SCRIPTS, (ord(char), "\U0010ffff")) - 1][1]


def pieces_of(word: str) -> list[str]:
    """A word cut where the script of its letters changes, and each part into consecutive pieces of at most PIECE signs."""
    cuts = [0]
    if not word.isascii() and max(word) >= "\u0370":  # below it all is Latin
        last = None
        for i, c in enumerate(word):
            if c.isalpha() and (s := script_of(c)) != last:
                if last is not None:
                    cuts.append(i)
                last = s
    if len(cuts) == 1 and len(word) <= PIECE:
        return [word]
    return [word[i : min(i + PIECE, b)] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True) for i in range(a, b, PIECE)]


def features(words: list[str]):
    """(bucket, word number) of the features of lower-cased words: the word itself and its marked runs of 2 to 4 signs."""
    import zlib

    import numpy as np

    from .shingles import mix

    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, marked), np.int64, len(marked)))
    buckets = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in marked], np.uint64)]
    owners = [np.arange(len(words))]
    for n in (2, 3, 4):
        end = max(0, len(codes) - n + 1)
        h = np.full(end, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : k + end]
        inside = owner[:end] == owner[n - 1 :][:end]
        buckets.append(mix(h[inside]))
        owners.append(owner[:end][inside])
    return (np.concatenate(buckets) % np.uint64(FEATURES)).astype(np.int64), np.concatenate(owners)


def letters_of(word: str) -> tuple[int, str]:
    """How many letters a word has and the script of the first."""
    if word.isalpha():
        return len(word), "Latin" if word.isascii() else script_of(word[0])
    n = sum(map(str.isalpha, word))
    return n, script_of(next(filter(str.isalpha, word))) if n else ""


def _counter(languages: list[str]):
    def make():
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        def step(batch):
            n, scripts = Counter(), Counter()
            found: dict[int, Counter] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(languages.index(lang), Counter()).update(text.lower().split())
            for k, whole in found.items():
                times = Counter()
                for w, c in whole.items():
                    for piece in pieces_of(w):
                        times[piece] += c
                words = [w for w in times if letters_of(w)[0]]
                weights = np.array([times[w] for w in words], np.float64)
                buckets, owner = features(words)
                sums = np.bincount(buckets, weights[owner], FEATURES)
                n.update({(k, f): int(sums[f]) for f in np.flatnonzero(sums).tolist()})
                for w in words:
                    scripts[k, letters_of(w)[1]] += times[w]
            rows = [(k, f"{f}", c) for (k, f), c in n.items()] + [(k, s, c) for (k, s), c in scripts.items()]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["k", "f", "n"])

        return step

    return make


class Model:
    """Log-likelihood ratios of hashed features, and the languages that each script was seen in."""

    def __init__(self, languages: list[str], weights, scripts: dict[str, list[int]]):
        self.languages, self.weights, self.scripts = languages, weights, scripts
        self.rows: dict[str, int] = {}
        self.scores = self.letters = self.counts = None

    def score(self, words: list[str]):
        """(scores by language, letters) of words, each of one script. A word's script names its candidates; the others are
        not scored and stand EXCLUDED below the best. A word without a letter, or in a script that was never seen, says nothing."""
        import numpy as np

        low = [w.lower() for w in words]
        seen = [letters_of(w) for w in low]
        letters = np.array([n for n, _ in seen], np.int64)
        out = np.zeros((len(words), len(self.languages)))
        scripts: dict[str, list[int]] = {}
        for i, (_, script) in enumerate(seen):
            scripts.setdefault(script, []).append(i)
        for script, at in scripts.items():
            if script not in self.scripts:
                continue
            ks, n = self.scripts[script], letters[at]
            got = np.zeros((len(at), len(ks)))
            if len(ks) > 1:
                buckets, owner = features([low[i] for i in at])
                size = np.bincount(owner, minlength=len(at))
                w = self.weights[:, ks][buckets] if len(ks) < len(self.languages) else self.weights[buckets]
                got = np.stack([np.bincount(owner, w[:, k], len(at)) for k in range(len(ks))], axis=1) / size[:, None]
                got *= np.minimum(4.0, 1 + 0.5 * n)[:, None]
                got = np.maximum(got - got.max(axis=1, keepdims=True), -8.0)
            whole = np.full((len(at), len(self.languages)), -EXCLUDED)
            whole[:, ks] = got
            out[at] = whole
        return out, letters

    def forget(self) -> None:
        self.rows.clear()
        self.scores = self.letters = self.counts = None

    def look_up(self, words: list[str]):
        """Numbers of the first rows of words in the score table; the rows of a word's other pieces follow."""
        import numpy as np

        sole_cache("languages", self.forget)
        if self.scores is None or len(self.letters) > WORDS:
            self.forget()
            self.scores, self.letters, self.counts = np.empty((0, len(self.languages))), np.empty(0, np.int64), np.empty(0, np.int64)
        rows = self.rows
        fresh = list({w for w in words if w not in rows})
        if fresh:
            parts = [pieces_of(w) for w in fresh]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            rows.update(zip(fresh, (len(self.letters) + np.cumsum(size) - size).tolist(), strict=True))
            self.counts = np.concatenate((self.counts, np.repeat(size, size)))
            pieces = [p for part in parts for p in part]
            for at in range(0, len(pieces), 10_000):
                s, n = self.score(pieces[at : at + 10_000])
                self.scores, self.letters = np.concatenate((self.scores, s)), np.concatenate((self.letters, n))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def label(self, scores) -> list[int]:
        """Viterbi: the language of each piece at the highest sum of scores less SWITCH for each change."""
        rows = scores.tolist()
        best, back = rows[0], []
        for row in rows[1:]:
            top = max(best)
            first, floor = best.index(top), top - SWITCH
            back.append([k if b >= floor else first for k, b in enumerate(best)])
            best = [(b if b >= floor else floor) + s for b, s in zip(best, row, strict=True)]
        path = [best.index(max(best))]
        for row in reversed(back):
            path.append(row[path[-1]])
        return path[::-1]

    def labels(self, texts: list[str]):
        """For each text: (language of each piece, letters of each piece); most words are one piece."""
        return [(langs, letters) for langs, letters, _ in self.label_pieces(texts)]

    def label_pieces(self, texts: list[str]):
        """For each text: (language, letters, word number) of each piece. One language, the lead, is kept throughout where no
        path with changes can be better. Such a path either holds the lead somewhere, and then pays a change for each stretch
        in another language, so one of them gains more than SWITCH over it; or m > 1 stretches in other languages cover the
        text at m - 1 changes. If none gains more than SWITCH, the first and the last then gain more than SWITCH together."""
        import numpy as np

        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words])
        flat = self.look_up([w for part in words for w in part])
        size = self.counts[flat]
        before = np.concatenate(([0], np.cumsum(size)))
        word_no = np.repeat(np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), size)
        sizes = before[np.cumsum(sizes)] - before[np.cumsum(sizes) - sizes]
        flat = np.repeat(flat - before[:-1], size) + np.arange(before[-1])
        letters, s = self.letters[flat], self.scores[flat]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        full = np.flatnonzero(sizes)
        out = np.zeros(len(flat), np.int64)
        if len(full) and len(self.languages) > 1:
            lead = np.add.reduceat(s, starts[full], axis=0).argmax(axis=1)
            own = np.repeat(lead, sizes[full])
            out[:] = own
            mine = s[np.arange(len(flat)), own]
            mixed = np.zeros(len(full), bool)
            head, tail = np.full(len(full), -np.inf), np.full(len(full), -np.inf)  # the most that one language gains over a prefix, over a suffix
            for k in range(len(self.languages)):
                gain = s[:, k] - mine
                # A drop between texts below all that a text can gain, so that runs end with their text.
                drop = float(np.abs(gain).sum()) + 1 if len(full) < 2 else float(np.add.reduceat(np.abs(gain), starts[full]).max()) + 1
                text_no = np.repeat(np.arange(len(full)), sizes[full])
                plain = np.cumsum(gain)
                base = plain[starts[full]] - gain[starts[full]]
                foreign = lead != k
                head = np.where(foreign, np.maximum(head, np.maximum.reduceat(plain, starts[full]) - base), head)
                tail = np.where(foreign, np.maximum(tail, plain[ends[full] - 1] - np.minimum.reduceat(plain, starts[full])), tail)
                total = plain - drop * text_no
                low = np.minimum.accumulate(np.concatenate(([0.0], total[:-1])) - drop * np.concatenate(([0], (text_no[1:] != text_no[:-1]).astype(int))))
                mixed |= np.maximum.reduceat(total - low, starts[full]) > SWITCH
            mixed |= head + tail > SWITCH - 1e-6
            for i in np.flatnonzero(mixed).tolist():
                a, b = starts[full[i]], ends[full[i]]
                out[a:b] = self.label(s[a:b])
        return [(out[a:b], letters[a:b], word_no[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from (text, lang) of rows with both. A bounded sample of them, about `sample` rows chosen by a hash of doc_id,
    is counted on the executors; at most languages x (FEATURES + scripts) sums reach the driver. Of rows that repeat a doc_id
    all or none are drawn; rows without one share a draw. Without a labelled row nothing is learned."""
    import numpy as np

    rows = docs.where("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    total = rows.count()
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < math.ceil(1_000_000 * sample / total))
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    counts = map_rows(rows.select("lang", "text"), _counter(languages), "k int, f string, n long").groupBy("k", "f").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((FEATURES, len(languages)))
    seen: dict[str, list[float]] = {}
    for k, f, c in zip(*(x.to_pylist() for x in counts.columns), strict=True):
        if f.isdigit():
            n[int(f), k] = c
        else:
            seen.setdefault(f, [0.0] * len(languages))[k] += c
    weights = np.log(n + 0.5) - np.log(n.sum(axis=0) + 0.5 * FEATURES)
    weights -= weights.mean(axis=1, keepdims=True) if len(languages) else 0
    words = [sum(s[k] for s in seen.values()) for k in range(len(languages))]
    scripts = {s: [k for k, c in enumerate(by) if c > 0.01 * words[k]] for s, by in seen.items()}
    return Model(languages, weights.astype(np.float32), {s: ks for s, ks in scripts.items() if ks})


@functools.lru_cache(1)
def _loaded(raw: bytes) -> Model:
    """The model in use; a worker keeps no former one."""
    return pickle.loads(raw)


def _slices(texts: list[str]):
    """Consecutive texts with about SLICE words at most, so that a batch's tables stay small."""
    held, size = [], 0
    for t in texts:
        n = len(t) // 2 + 1
        if held and size + n > 4 * SLICE:
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


def _predictor(shared, spans: bool):
    def make():
        import numpy as np
        import pyarrow as pa

        def step(batch):
            model = _loaded(shared.value)
            names, scores, runs = [], [], []
            for part in _slices(batch.column(1).to_pylist()):
                for langs, letters, word_no in model.label_pieces(part):
                    by = np.bincount(langs, letters, len(model.languages)) if len(langs) else np.zeros(1)
                    total = by.sum() if model.languages else 0
                    names.append(model.languages[int(by.argmax())] if total else UNKNOWN)
                    scores.append(float(by.max() / total) if total else 0.0)
                    if spans:
                        cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)] if len(langs) else [0]
                        runs.append([{"first": int(word_no[a]), "words": int(word_no[b - 1] - word_no[a]) + 1, "lang": model.languages[langs[a]]} for a, b in zip(cuts, cuts[1:], strict=False)] if total else [])
            cols = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
                cols.append(pa.array(runs, kind))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "spans"][: len(cols)])

        return step

    return make


def predict(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]), one row for each row of docs, from the text alone.

    Words are parted by white space, and cut into pieces where their script changes and after every PIECE signs; all pieces
    count. The prediction is the language with the most letters under its spans, the score its
    share of the text's letters. Null, empty and letterless texts are `und` with score 0, as is every text where nothing was
    learned. Ties go to the language whose name sorts first. Equal texts get equal results. A span is (first word, words, lang);
    where the language changes within a word, the word belongs to both spans.
    """
    small = Model(model.languages, model.weights, model.scripts)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(small))  # FEATURES x languages x 4 bytes
    kind = "doc_id long, lang_pred string, score double" + (", spans array<struct<first: long, words: long, lang: string>>" if spans else "")
    return map_rows(keyed_text(docs), _predictor(shared, spans), kind)


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, with all of their columns, whose text has a language; null and letterless texts go. No shuffle."""
    small = Model(model.languages, model.weights, model.scripts)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(small))
    place = docs.columns.index(text)

    def make():
        import pyarrow as pa

        def step(batch):
            fast, keep = _loaded(shared.value), []
            for part in _slices([t or "" for t in batch.column(place).to_pylist()]):
                keep += [bool(letters.sum()) for _, letters in fast.labels(part)]
            yield batch.filter(pa.array(keep, pa.bool_()))

        return step

    return map_rows(docs, make, docs.schema)


def held_out(doc_id="doc_id"):
    """Whether a row belongs to the fold that is never learned from."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2
