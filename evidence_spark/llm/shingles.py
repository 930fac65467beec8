"""Word shingles and SuperMinHash signatures, computed on numpy arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import sole_cache

#: Words of a shingle. Words are parted by space and the controls 9 to 13, just as bytes.split() does without arguments.
WORDS = 5
#: Slots of a signature.
SLOTS = 128
#: Words whose hashes a worker keeps; the table is emptied when full.
WORD_CACHE = 250_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word, 0x5EED)
        return value


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; A-Z count as a-z; with fewer words than size, of the whole sequence."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    sole_cache("shingles", _hashes.clear)
    if len(_hashes) > WORD_CACHE:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if n > 1 else out


def super_minhash(items: np.ndarray, slots: int = SLOTS, block: int = 2048) -> np.ndarray:
    """SuperMinHash: 64-bit signature slots of a set of hashes.

    Every item walks a random permutation of the slots, made as a Fisher-Yates shuffle seeded by its hash; its step j puts
    the rank j + u, u in [0, 1), on the slot that the shuffle gives. A slot keeps the lowest rank of all items. Once every
    slot holds a rank below j, later steps cannot lower any, and the walk stops. Ranks are held as j * 2**32 + u * 2**32.
    """
    best = np.full(slots, np.uint64(slots) << np.uint64(32), np.uint64)
    if not len(items):
        return best
    for at in range(0, len(items), block):
        part = items[at : at + block]
        n = len(part)
        rows = np.arange(n)
        order = None
        for j in range(slots):
            if int(best.max()) >> 32 < j:
                break
            r = mix(part + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            to = j + (((r >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
            rank = (np.uint64(j) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF))
            if j == 0:
                slot = to
            else:
                if order is None:
                    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int64), (n, 1))
                    order[rows, first] = 0
                slot = order[rows, to].astype(np.int64)
                order[rows, to] = order[:, j]
            if j == 0:
                first = to
            if n > 64:
                o = np.lexsort((rank, slot))
                s = slot[o]
                head = np.concatenate(([True], s[1:] != s[:-1]))
                best[s[head]] = np.minimum(best[s[head]], rank[o][head])
            else:
                np.minimum.at(best, slot, rank)
    return best


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band of rows slots; the band's number is part of it."""
    bands = signature.reshape(-1, rows)
    out = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
    return out.view(np.int64)
