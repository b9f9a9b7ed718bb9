"""Words and shingles of many texts at once, as flat numpy arrays.

A word is a maximal run of characters other than the space and U+0009 to
U+000D, so it can be found on UTF-8 bytes.  Hashes are 64-bit; arithmetic
wraps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20260101))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_CODE_LOWER = BYTE_CODE.copy()
BYTE_CODE_LOWER[ord("A"):ord("Z") + 1] = BYTE_CODE[ord("a"):ord("z") + 1]
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
BASE = int(_rng.integers(1, 2**63)) | 5
BASE_INVERSE = pow(BASE, -1, 2**64)
# Bytes of text hashed together (a longer text is a batch of its own).
BATCH_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), wrapping, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have:have + take] = out[:take] * np.uint64(pow(base, have, 2**64))
        have += take
    return out[:n]


_POWERS: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BATCH_BYTES)
        up, down = powers(BASE, size), powers(BASE_INVERSE, size)
        if size > BATCH_BYTES:  # one very long text: not kept
            return up, down
        _POWERS.update(up=up, down=down)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """Words of a batch of texts."""
    raw: np.ndarray      # bytes of all texts, a newline between texts
    start: np.ndarray    # first byte of each word
    end: np.ndarray      # one past its last byte
    doc: np.ndarray      # index of its text
    first: np.ndarray    # first word of each text; one entry more at the end


def find_words(texts: list[bytes]) -> Words:
    """The words of every text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    stop = np.cumsum(sizes)
    word = ~BLANK[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.r_[0, edge]
    start, end = edge[::2], edge[1::2]
    first = np.searchsorted(start, np.r_[0, stop])
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(raw, start, end, doc, first)


def word_hashes(w: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (``lower``: with A-Z as a-z)."""
    n = len(w.raw)
    up, down = _power_tables(n)
    code = (BYTE_CODE_LOWER if lower else BYTE_CODE)[w.raw]
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(code * up[:n], out=total[1:])
    return mix((total[w.end] - total[w.start]) * down[w.start])


def batches_of(texts: list[bytes]):
    """(from, to) ranges of texts of bounded total length."""
    at = 0
    while at < len(texts):
        n, end = 0, at
        while end < len(texts) and (end == at or n + len(texts[end]) < BATCH_BYTES):
            n += len(texts[end]) + 1
            end += 1
        yield at, end
        at = end


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of its k-word shingles (A-Z lower-cased).

    A text of fewer words is one shingle, its whole sequence; one without words has none.
    """
    out: list[np.ndarray] = []
    seeds = mix(np.arange(1, k + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for at, end in batches_of(texts):
        w = find_words(texts[at:end])
        h = word_hashes(w, lower=True)
        n = len(h)
        whole = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            m = max(n - j, 0)
            whole[:m] += mix(h[j:] + seeds[j])
        whole = mix(whole)
        for i in range(end - at):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= k:
                out.append(np.unique(whole[a:b - k + 1]))
            elif b > a:
                out.append(mix(mix(h[a:b] + seeds[:b - a]).sum(keepdims=True) ^ seeds[k:] * np.uint64(b - a)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out
