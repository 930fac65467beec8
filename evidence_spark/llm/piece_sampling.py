"""Sampled SentencePiece segmentations without replacement: Gumbel top-k by A-star search over the lattice, and decoding.

The lattice of a text has an edge for each vocabulary piece that matches at a position; a sign outside the vocabulary has
one edge, its UTF-8 bytes. A BPE model stores merge ranks for scores, so a piece of rank r gets log-weight
-THETA * ln(r + SHIFT), and a segmentation the sum over its pieces, normalised over all segmentations of the text.

Backward sums turn the lattice into a Markov chain: at each state (chunk, position) the next piece has a probability of its
own, and no piece crosses the start of a chunk (see token_counts). A segmentation is a path of choices in text order. The
perturbed log-probability of the best path of a subtree is a Gumbel variable at the subtree's log-mass, bounded by its
parent's. The queue starts with the whole lattice. Taking the largest entry fixes a choice that no earlier sample made
there, draws the rest of the path top-down, and leaves one entry for the alternatives at each further choice. So the k
largest perturbed paths come out in order, distinct, without a walk over all paths. The chunks of many texts advance
together in numpy; every draw is a hash of the seed, the row's key, the sample and the place, so batches do not matter.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame

from .common import keyed_text, map_rows, sole_cache

SPACE = "▁"
#: Log-weight of a piece of merge rank r: -THETA * ln(r + SHIFT).
THETA, SHIFT = 1.0, 16.0
#: Segmentations of a text; states that a worker keeps between batches; characters of texts that are sampled together.
SAMPLES, STATES, TOGETHER = 2, 2_500_000, 300_000


class _Rows:
    """An array that grows at its end without a copy each time."""

    def __init__(self, start, dtype):
        import numpy as np

        self.held, self.n = np.zeros(1 << 12, dtype), 0
        self.add(np.array(start, dtype))

    def add(self, values) -> None:
        import numpy as np

        n = self.n + len(values)
        if n > len(self.held):
            self.held = np.concatenate((self.held[: self.n], np.empty(max(n, 2 * len(self.held)) - self.n, self.held.dtype)))
        self.held[self.n : n] = values
        self.n = n

    @property
    def rows(self):
        return self.held[: self.n]


class _Known(dict):
    """Numbers of chunks; those that are asked for the first time are also listed."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.fresh.append(chunk)
        return number


class Lattice:
    """The Markov chain of the lattice over all chunks seen so far. State 0 is the end of a chunk."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.surface = [sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.size)]
        self.byte_id = {}
        pieces = {}
        for i in range(self.size):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.surface[i], self.byte_id[b] = bytes([b]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[sp.id_to_piece(i)] = i, min(-sp.get_score(i), self.size)
        self.weight = np.full(self.size, -THETA * np.log(self.size + SHIFT))
        for i, rank in pieces.values():
            self.weight[i] = -THETA * np.log(rank + SHIFT)
        self.unknown = float(-THETA * np.log(self.size + SHIFT))
        # For each length, the hashes of all beginnings of pieces, sorted, and the piece that each is, if it is one.
        self.starts = []
        for n in range(1, max(map(len, pieces)) + 1):
            found = {p[:n]: -1 for p in pieces if len(p) >= n} | {p: i for p, (i, _) in pieces.items() if len(p) == n}
            codes = np.array([list(map(ord, p)) for p in found], np.uint64)
            h = np.zeros(len(found), np.uint64)
            for k in range(n):
                h = self._rolled(h, codes[:, k])
            order = np.argsort(h)
            if (np.diff(h[order].view(np.int64)) == 0).any():
                raise ValueError("two beginnings of pieces share a hash")
            self.starts.append((h[order], np.array(list(found.values()))[order]))
        self.pairs = np.unique(np.array([ord(x) << 32 | ord(y) for p in pieces for x, y in zip(p, p[1:], strict=False)], np.uint64))
        self.clear()

    @staticmethod
    def _rolled(h, code):
        import numpy as np

        from .shingles import mix

        return mix(h * np.uint64(0x9E3779B97F4A7C15) + code + np.uint64(1))

    def clear(self) -> None:
        import numpy as np

        self.known = _Known()  # chunks without their first space mark; atoms' first states lie at atoms[spans[k] : spans[k + 1]]
        self.spans, self.atoms = _Rows([0], np.int64), _Rows([], np.int64)
        self.start: dict[str, int] = {}  # of atoms
        self.signs: list[list[int]] = []
        self._first = _Rows([0, 0], np.int32)  # of a state's choices; one more entry than states
        self._cum, self._logp = _Rows([], np.float64), _Rows([], np.float64)  # by choice: cumulative probability and log-probability
        self._next, self._token = _Rows([], np.int32), _Rows([], np.int32)  # a token below 0 is a sign's bytes

    first, cum, logp, next, token = (property(lambda self, name=name: getattr(self, name).rows) for name in ("_first", "_cum", "_logp", "_next", "_token"))

    def _edges(self, codes, stop):
        """(from, to, token, log-weight) of all edges between positions of the concatenated chunks, by from, the longest first."""
        import numpy as np

        at = np.arange(len(codes))
        h = np.zeros(len(codes), np.uint64)
        parts, single = [], np.zeros(len(codes), bool)
        for n, (hashes, ids) in enumerate(self.starts, 1):
            inside = at + n <= stop[at]
            at, h = at[inside], h[inside]
            h = self._rolled(h, codes[at + n - 1])
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[k] == h
            at, h, token = at[known], h[known], ids[k[known]]
            whole = token >= 0
            parts.append((at[whole], at[whole] + n, token[whole]))
            if n == 1:
                single[at[whole]] = True
            if not len(at):
                break
        lone = np.flatnonzero(~single)
        weights = [self.weight[t] for _, _, t in parts]
        if len(lone):
            tokens, sizes = [], []
            for c in codes[lone].tolist():
                ids = [self.byte_id[b] for b in chr(c).encode()]
                sizes.append(len(ids))
                if len(ids) > 1:
                    self.signs.append(ids)
                tokens.append(ids[0] if len(ids) == 1 else -len(self.signs))
            parts.append((lone, lone + 1, np.array(tokens)))
            weights.append(self.unknown * np.array(sizes))
        a, b, t = (np.concatenate(x) for x in zip(*parts, strict=True))
        w = np.concatenate(weights)
        order = np.lexsort((-b, a))
        return a[order], b[order], t[order], w[order]

    def states(self, chunks: list[str]):
        """The first states of all atoms of chunks, in order, and how many each chunk has; new chunks are added.

        Chunks lack their first space mark. No piece holds two signs between which an atom ends, so atoms are independent.
        """
        import numpy as np

        sole_cache("lattice", self.clear)
        k = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        fresh, self.known.fresh = self.known.fresh, []
        if fresh:
            text = "".join([SPACE + c for c in fresh])
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
            ends = np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1)
            pair = codes[:-1] << np.uint64(32) | codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            cut = np.concatenate((self.pairs[at] != pair, [True]))
            cut[ends - 1] = True
            stops = (np.flatnonzero(cut) + 1).tolist()
            atoms = [text[i:j] for i, j in zip([0, *stops], stops, strict=False)]
            self._add(list({x for x in atoms if x not in self.start}))
            counts = np.add.reduceat(cut.astype(np.int64), np.concatenate(([0], ends[:-1])))
            self.spans.add(self.spans.rows[-1] + np.cumsum(counts))
            self.atoms.add(np.fromiter(map(self.start.__getitem__, atoms), np.int64, len(atoms)))
        spans = self.spans.rows
        n = spans[k + 1] - spans[k]
        return self.atoms.rows[np.repeat(spans[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def _add(self, fresh: list[str]) -> None:
        """States of new atoms."""
        import numpy as np

        if not fresh:
            return
        codes = np.frombuffer("".join(fresh).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        stop = np.repeat(np.cumsum(sizes), sizes)
        a, b, token, w = self._edges(codes, stop)
        first = np.searchsorted(a, np.arange(len(codes) + 1))
        # Backward sums, by distance from the end of the chunk.
        beta = np.zeros(len(codes) + 1)
        distance = stop - np.arange(len(codes))
        order = np.argsort(distance, kind="stable")
        bounds = np.searchsorted(distance[order], np.arange(1, int(distance.max()) + 2))
        ends = stop[a]
        for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            here = order[lo:hi]
            n = first[here + 1] - first[here]
            cuts = np.cumsum(n) - n
            e = np.repeat(first[here] - cuts, n) + np.arange(int(n.sum()))
            m = w[e] + np.where(b[e] == ends[e], 0.0, beta[b[e]])
            top = np.maximum.reduceat(m, cuts)
            beta[here] = top + np.log(np.add.reduceat(np.exp(m - np.repeat(top, n)), cuts))
        logp = w + np.where(b == ends, 0.0, beta[b]) - beta[a]
        cum = np.exp(logp)
        for k in range(1, int(np.diff(first).max())):  # within each state, in the same way whatever else is in the batch
            at = first[:-1][np.diff(first) > k] + k
            cum[at] += cum[at - 1]
        cum[first[1:] - 1] = 2.0
        base, choices = self._first.n - 1, self._cum.n
        self._first.add(first[1:] + choices)
        self._cum.add(cum)
        self._logp.add(np.minimum(logp, 0.0))
        self._token.add(token)
        self._next.add(np.where(b == ends, 0, base + b))
        self.start.update(zip(fresh, (base + np.cumsum(sizes) - sizes).tolist(), strict=True))

    def chunks(self, text: str) -> list[str]:
        """Runs of space marks with what follows, each without its first mark; the library puts one before the text."""
        if not text:
            return []
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return words
        return [x[1:] for x in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]

    @staticmethod
    def _uniform(seeds, place):
        """Numbers in (0, 1) from seeds and places."""
        import numpy as np

        from .shingles import mix

        return ((mix(seeds + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)

    def _draw(self, states, u):
        """The choice at each state that u falls on. The longest piece comes first and mostly is the one."""
        import numpy as np

        cum, choice, open_ = self.cum, self.first[states], np.arange(len(states))
        while len(open_):
            open_ = open_[cum[choice[open_]] <= u[open_]]
            choice[open_] += 1
        return choice

    def _walk(self, states, doc, atom, depth, seeds):
        """Steps (doc, atom, depth, state, choice) from the given states to the ends of their atoms, in text order.

        All walk in step; where each step belongs follows from how many its atom has, without a sort.
        """
        import numpy as np

        layers, who, steps, after = [], np.arange(len(states)), np.zeros(len(states), np.int64), self.next
        while len(states):
            at = depth[who] + len(layers)
            u = self._uniform(seeds[doc[who]], atom[who] * 1024 + np.minimum(at, 1023))
            if (at >= 1023).any():  # one draw would serve two places
                u = self._uniform(seeds[doc[who]] ^ at.astype(np.uint64), atom[who])
            choice = self._draw(states, u)
            layers.append((who, states, choice))
            steps[who] += 1
            states = after[choice]
            on = states > 0
            states, who = states[on], who[on]
        begin = np.cumsum(steps) - steps
        owner = np.repeat(np.arange(len(steps)), steps)
        state, choice = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
        for k, (who, s, c) in enumerate(layers):
            state[begin[who] + k], choice[begin[who] + k] = s, c
        return doc[owner], atom[owner], depth[owner] + np.arange(len(owner)) - begin[owner], state, choice

    def sample_all(self, texts: list[list[str]], keys: list[int], k: int, seed: int) -> list[tuple[list, float | None]]:
        """For each text's chunks: up to k (tokens, log-probability, perturbed log-probability), best first, and the
        largest perturbed value that was not drawn (None where all were)."""
        import numpy as np

        from .shingles import mix

        n = len(texts)
        base = mix(np.array([(x or 0) & (1 << 64) - 1 for x in keys], np.uint64) ^ mix(np.uint64([seed & (1 << 64) - 1] * n)))
        flat, counts = self.states([c for part in texts for c in part])
        first, logp, token = self.first, self.logp, self.token
        ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, n))))]
        sizes = np.diff(ends)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        noise = lambda r, what, place: -np.log(self._uniform(mix(base + np.uint64(4 * r + what)), place))  # noqa: E731  exponential
        zero = np.zeros(n, np.int64)
        bound = -np.log(noise(0, 0, zero))
        out: list[list] = [[] for _ in range(n)]
        # Entries of the queue by text: per path its steps, and for each step the perturbed and plain mass of its alternatives.
        paths: list[list] = [[] for _ in range(n)]
        lead, live = np.zeros(n), np.arange(n)
        doc = np.repeat(np.arange(n), sizes)
        steps = self._walk(flat, doc, np.arange(len(flat)) - offsets[:-1][doc], np.zeros(len(flat), np.int64), mix(base + np.uint64(1)))
        prefix: list = [None] * n
        for r in range(k):
            d, c, depth, states, choices = steps
            p, tokens = logp[choices], token[choices]
            cuts = np.searchsorted(d, np.arange(n + 1))
            run = np.concatenate(([0.0], np.cumsum(p)))
            before = lead[d] + run[:-1] - run[cuts[:-1]][d]
            alone = first[states + 1] - first[states] == 1
            with np.errstate(divide="ignore", over="ignore"):
                mass = np.where(alone, -np.inf, before + np.log(-np.expm1(p)))
                e = -np.log(self._uniform(mix(base + np.uint64(4 * r + 2))[d], np.arange(len(d)) - cuts[:-1][d]))
                queue = np.where(alone, -np.inf, mass - np.log(e + np.exp(mass - bound[d])))
            total = lead + run[cuts[1:]] - run[cuts[:-1]]
            for i in live.tolist():
                a, b = cuts[i], cuts[i + 1]
                own = tokens[a:b]
                out[i].append((own if prefix[i] is None else np.concatenate((prefix[i], own)), float(total[i]), float(bound[i])))
                paths[i].append((c[a:b], depth[a:b], states[a:b], choices[a:b], mass[a:b], queue[a:b], before[a:b], out[i][-1][0], len(out[i][-1][0]) - (b - a), {}))
            if r + 1 == k:
                break
            again, parts = [], []
            for i in live.tolist():
                best, path = max(((float(q.max()), j) for j, (_, _, _, _, _, q, *_) in enumerate(paths[i]) if len(q)), default=(-np.inf, 0))
                if np.isneginf(best):
                    continue
                pc, pd, ps, po, pm, pq, pb, pre, skip, gone = paths[i][path]
                at = int(pq.argmax())
                options = np.arange(first[ps[at]], first[ps[at] + 1])
                taken = gone.setdefault(at, [int(po[at])])
                free = np.array([o for o in options.tolist() if o not in taken])
                w = np.cumsum(np.exp(logp[free] - logp[free].max()))
                draw = self._uniform(mix(base[i : i + 1] + np.uint64(4 * r + 3)), np.zeros(1))[0]
                new = int(free[min(int(np.searchsorted(w, draw * w[-1], side="right")), len(free) - 1)])
                taken.append(new)
                rest = free[free != new]
                pm[at] = pb[at] + np.logaddexp.reduce(logp[rest]) if len(rest) else -np.inf
                noise_at = -np.log(self._uniform(mix(base[i : i + 1] + np.uint64(4 * r + 3)), np.ones(1))[0])
                pq[at] = pm[at] - np.log(noise_at + np.exp(pm[at] - best)) if len(rest) else -np.inf
                prefix[i] = np.append(pre[: skip + at], token[new])
                lead[i], bound[i] = pb[at] + logp[new], best
                again.append(i)
                state, here = int(self.next[new]), int(pc[at])
                later = flat[offsets[i] + here + 1 : offsets[i + 1]]
                if state:
                    parts.append((np.array([state]), np.array([i]), np.array([here]), np.array([int(pd[at]) + 1])))
                parts.append((later, np.full(len(later), i), here + 1 + np.arange(len(later)), np.zeros(len(later), np.int64)))
            live = np.array(again, np.int64)
            if not again:
                break
            joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
            steps = self._walk(*joined, mix(base + np.uint64(4 * r + 5)))
        bounds = []
        for i in range(n):
            left = max((float(q.max()) for _, _, _, _, _, q, *_ in paths[i] if len(q)), default=-np.inf)
            bounds.append(None if np.isneginf(left) else left)
        return list(zip(out, bounds, strict=True))

    def ids(self, tokens):
        """Little-endian 32-bit ids of a path's tokens, signs outside the vocabulary as their bytes."""
        import numpy as np

        if len(tokens) and tokens.min() < 0:
            flat = []
            for x in tokens.tolist():
                flat += self.signs[-x - 1] if x < 0 else [x]
            tokens = np.array(flat)
        return tokens.astype("<u4")

    def decode(self, ids) -> str:
        """The text of ids: surfaces and bytes joined, space marks to spaces, without the one put before the text."""
        text = self.bytes_of(ids).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def bytes_of(self, ids) -> bytes:
        return b"".join(map(self.surface.__getitem__, ids))


@functools.cache
def lattice(path: str) -> Lattice:
    return Lattice(path)


SCHEMA = "doc_id long, sample int, n_tokens long, ids binary, ids_crc32 long, log_prob double, perturbed double, inclusion double, decodes boolean"


def _sampler(path: str, k: int, seed: int, keep_ids: bool):
    def make():
        import math
        import zlib

        import numpy as np
        import pyarrow as pa

        def step(batch):
            table, keys, texts = lattice(path), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts]) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                if table._first.n > STATES:
                    table.clear()
                split = [table.chunks(t) for t in texts[at:to]]
                rows = []
                for key, text, (found, bound) in zip(keys[at:to], texts[at:to], table.sample_all(split, keys[at:to], k, seed), strict=True):
                    whole = (" " * bool(text) + text.replace(SPACE, " ")).encode()
                    for i, (tokens, logp, g) in enumerate(found):
                        ids = table.ids(tokens)
                        raw = ids.tobytes()
                        inclusion = 1.0 if bound is None else -math.expm1(-math.exp(min(50.0, logp - bound)))
                        rows.append((key, i, len(ids), raw if keep_ids else None, zlib.crc32(raw), logp, g, inclusion, table.bytes_of(ids.tolist()) == whole))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        return step

    return make


def sample_segmentations(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = 7, keep_ids: bool = True) -> DataFrame:
    """(doc_id, sample, n_tokens, ids, ids_crc32, log_prob, perturbed, inclusion, decodes): up to k distinct segmentations of
    each row's text, fewer where it has fewer.

    Samples come in falling perturbed log-probability. inclusion is the probability that a path's perturbed value lies above
    the largest value that was not drawn, so log_prob and inclusion weight estimates as in priority sampling; it is 1 where
    every segmentation was drawn. The draws are seeded by seed and doc_id: rows that repeat both get equal results. Null
    counts as empty; an empty text has one empty segmentation. decodes tells whether the ids decode to the text, in which a
    space mark and a space are the same. Other columns are ignored; an empty table gives an empty result.
    """
    return map_rows(keyed_text(docs), _sampler(model, k, seed, keep_ids), SCHEMA)


def decode_ids(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids) with little-endian 32-bit ids; null ids give a null text."""

    def make():
        import numpy as np
        import pyarrow as pa

        def step(batch):
            table = lattice(model)
            texts = [None if x is None else table.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

        return step

    return map_rows(rows.select("doc_id", "ids"), make, "doc_id long, text string")
